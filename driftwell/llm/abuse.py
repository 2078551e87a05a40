"""Abusive, hateful or sexual content (problem 3).

Words are brought to a plain spelling and matched by a Levenshtein automaton that runs along a trie of the lexicon's words, so
that misspelled and masked terms are found; runs of such words make the lexicon's terms.  Around each term a window of the
sentence is scored by a logistic model over what surrounds it (who is meant, who speaks, is it quoted or reported), which tells
abuse from harmless uses.  The model starts from the weights below and is fitted on a bounded sample of labelled posts.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.llm import lexicon
from driftwell.llm.common import INVISIBLE, current, fold, latin_words, spread

#: Classes of the lexicon's terms; learned ones come from labelled posts.
CLASSES = ("insult", "threat", "hate", "sexual", "learned")
#: Words that say who is meant, who speaks and whether someone reports.
CUES = {
    "you": "you your yourself u ur tu te ti tú tus toi ton ta vous votre du dich dir dein deine você teu tua tuo ты тебя тебе твой お前 あなた",
    "self": "i me my mine myself yo me mi moi je mon ma ich mich mir mein meine eu meu io mio я меня мне мой",
    "report": "said says say called calls calling shouts shouted asked told covers law report reports reported study studies quoted quotes wrote article novel film book story character speech research debate word words term dijo dit sagte disse сказал",
    "mild": "love cute beautiful wonderful tiny please kind thanks great lovely happy glad",
    "they": "they them their all every the los les die todos tous alle people gli os они",
}
#: Starting weights: bias, one for each class, more than one class or term, a disguised spelling, each cue, inside quotation marks, no cue of you or they.
PRIOR = {"bias": -2.2, "insult": 1.0, "threat": 2.2, "hate": 1.4, "sexual": 1.0, "learned": 1.0, "several": 1.0, "disguised": 2.0, "you": 1.8, "self": -1.2, "report": -1.6, "mild": -2.0, "they": 0.8, "quoted": -1.0}
NAMES = tuple(PRIOR)
#: Hashed n-grams of the window, and how far it reaches on each side of a term.
BITS, REACH = 14, 9
#: Labelled posts that the model is fitted on, at most.
SAMPLE = 20_000
#: Labelled abusive posts that a learned term must be in, the share of its labelled posts that they must be, how much likelier
#: (as a logarithm) than by chance so many are, and its words at most.
SEEN, SHARE, LIKELIER, WORDS = 4, 0.4, 7.0, 4
#: Score from which a post counts as abusive.
LIMIT = 0.5

_TOKEN = re.compile(r"[^\W_]+(?:[*'’\-$@_]+[^\W_]+)*[*$]*|(?<![*$@])[*$@]++[^\W_]+(?:[*'’\-$@]+[^\W_]*)*")
_JOINT = re.compile(r"[-'’]")
_SPACED = re.compile(r"(?<![\w*])(?:[\w*@$] ){2,}[\w*@$](?![\w*])")
_STRESS = re.compile(r"(?<![\w*])(\*{1,3})(?=[^\s*])([^*\n]+)(?<=[^\s*])\1(?![\w*])")
#: Marks that open a quotation, that close one, and that do both.
_QUOTES = re.compile("[“„«「『]"), re.compile("[”»」』]"), re.compile('"')
_STRETCH = re.compile(r"([^\W\d_])\1{2,}")
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "€": "e"})
_BOUND = re.compile(r"(?<=[.!?…。！？])[\"”“»')\]]*\s+|(?<=[。！？])|\n+|\r")
_TAG = re.compile(r"<[^<>\n]*+>|\b(?:https?://|www\.)\S+|&(?:[a-zA-Z]{2,8}|#\d{1,6});|!?\[(?=[^\[\]\n]*+\]\()|\]\([^)\s]*\)")
_JAPANESE = re.compile(r"[぀-ヿ一-鿿]")
_JAPANESE_RUN = re.compile(r"[぀-ヿ一-鿿]+")
_SCRIPT = re.compile(r"[぀-ゟ]+|[゠-ヿ]+|[一-鿿]+")
#: Japanese words and forms that a term stands in by chance; the longest word at a place counts.
HARMLESS = "ばかり ばかなり ばかえ ばかか バカンス バカラ クズレ ピエロ エロージョン エロイカ 死ねない 死ねば 死ねる 死ねた 死ねます".split()


#: Letters that look or sound alike.
_ALIKE = {a: g.replace(a, "") for g in ("uv", "ckq", "sz", "ily", "wv") for a in g} | {"v": "uw"}


class Trie:
    """A trie of words; ``near`` runs a Levenshtein automaton along it."""

    def __init__(self, words: set[str]):
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w

    def longest(self, text: str, at: int) -> int:
        """The end of the longest word of the trie that begins at ``at`` in ``text``; ``at`` where none does."""
        node, end = self.root, at
        for i in range(at, len(text)):
            node = node.get(text[i])
            if node is None:
                break
            if "" in node:
                end = i + 1
        return end

    def near(self, word: str, most: float, soft: bool = False, heads: str = "") -> tuple[str, float] | None:
        """(lexicon word, edits) of the nearest word within ``most`` edits; * in ``word`` is any one letter, free of cost.

        ``soft`` edits cost one half where a letter stands for one that looks or sounds like it, or a letter is doubled or the
        second of a pair is left out.  ``heads`` are the first letters to look among, where given.
        A state of the automaton is the row of edit costs against the prefixes of ``word``; a branch of the trie is left as
        soon as no cost of its state is within ``most``.  Ties go to the first in alphabetical order.
        """
        best: tuple[float, str] | None = None
        double = [1 - 0.5 * (soft and i > 0 and x == word[i - 1]) for i, x in enumerate(word)]  # cost of a letter too many
        row = [0.0]
        for d in double:
            row.append(row[-1] + d)
        stack = [(self.root, tuple(row), "")]
        while stack:
            node, row, last = stack.pop()
            for c, nxt in node.items():
                if heads and node is self.root and c not in heads:
                    continue
                if c == "":
                    if row[-1] <= most and (best is None or (row[-1], nxt) < best):
                        best = (row[-1], nxt)
                    continue
                left = 0.5 if soft and (c == last or last + c == "ck") else 1  # cost of a letter left out
                like = _ALIKE.get(c, "") if soft else ""
                cost = [row[0] + left]
                for i, x in enumerate(word):
                    cost.append(min(cost[i] + double[i], row[i + 1] + left, row[i] + (0 if x == c or x == "*" else 0.5 if x in like else 1)))
                if min(cost) <= most:
                    stack.append((nxt, tuple(cost), c))
        return (best[1], best[0]) if best else None


def _reach(word: str) -> float:
    """Edits allowed for a word of this length: half a one for 3 to 5 letters, one up to 8, else two."""
    n = len(word.replace("*", ""))
    return 0 if n <= 2 else 0.5 if n <= 5 else 1 if n <= 8 else 2


class Lexicon:
    """The lexicon's terms as runs of words, found in any disguise."""

    def __init__(self, terms: dict[str, list[str]] | None = None, ordinary: frozenset[str] = frozenset(), learned: list[tuple[str, ...]] | None = None):
        self.terms = lexicon.terms() if terms is None else terms
        self.runs: dict[str, list[tuple[tuple[str, ...], str]]] = {}
        words = set()
        known = set()
        for kind, own in [*self.terms.items(), ("learned", learned or [])]:
            for term in own:
                run = tuple(self.words(term)) if isinstance(term, str) else term
                if run and (run, kind) not in known:
                    known.add((run, kind))
                    self.runs.setdefault(run[0], []).append((run, kind))
                    # a word of a longer run, or a learned one, is matched as it is written: it may be any small word
                    if kind != "learned" and (len(run) == 1 or all(len(w) > 4 for w in run)):
                        words.update(run)
        self.plain = {w for own in self.runs.values() for run, _ in own for w in run} - words
        self.lexical, self.width = words, max(map(len, words), default=0)
        self.trie, self.ordinary = Trie(words), ordinary
        known = words.union(self.plain, HARMLESS, *(c.split() for c in CUES.values()))
        self.japanese = Trie({w for w in known if _JAPANESE_RUN.fullmatch(w)})
        self.longest = max(map(len, self.lexical | self.plain | self.ordinary), default=1)
        self.held: dict[str, tuple[str, bool]] = {}

    @staticmethod
    def words(text: str) -> list[str]:
        return [w for t in _TOKEN.findall(fold(text)) for w in re.split(r"[-'’]", t) if w]

    def tokens(self, low: str) -> list[tuple[str, int]]:
        """(word, place) of a sentence in lower case.

        Japanese is written without spaces: a trie scan finds the known words in its runs, the rest is split by script.
        """
        out, at = [], 0
        for run in [*_JAPANESE_RUN.finditer(low), None]:
            end = run.start() if run else len(low)
            out += [(w, m.start()) for m in _TOKEN.finditer(low, at, end) for w in (_JOINT.split(m.group()) if _JOINT.search(m.group()) else (m.group(),)) if w]
            if run:
                i = rest = end
                at = run.end()
                while i < at:
                    known = min(at, self.japanese.longest(low, i))
                    if known > i:
                        out += [(m.group(), m.start()) for m in _SCRIPT.finditer(low, rest, i)]
                        out.append((low[i:known], i))
                        rest = known
                    i = max(known, i + 1)
                out += [(m.group(), m.start()) for m in _SCRIPT.finditer(low, rest, at)]
        return out

    def spell(self, raw: str) -> tuple[str, bool]:
        """(word, disguised): the lexicon's word that a written one stands for, else the word in plain spelling."""
        got = self.held.get(raw)
        if got is None:
            got = self._spell(raw)
            if len(self.held) > 200_000:
                self.held.clear()
            self.held[raw] = got
        return got

    def _spell(self, raw: str) -> tuple[str, bool]:
        w = raw
        odd = False
        if w in self.lexical or w in self.plain:
            return w, False
        if any(c in "013457@$" for c in w) and any(c.isalpha() for c in w) and not re.fullmatch(r"\d+[a-z]{1,2}", w):
            w, odd = w.translate(_LEET), True
        if _STRETCH.search(w):
            one = _STRETCH.sub(r"\1", w)
            two = _STRETCH.sub(r"\1\1", w)
            known = self.lexical | self.plain
            w, odd = two if two in known and one not in known else one, True
        odd |= "*" in w
        if w in self.lexical or w in self.plain:
            return w, odd
        if not odd and (w in self.ordinary or len(w) < 3) or len(w) > self.width + 2:  # no lexicon word is within two edits
            return w, False
        stars = w.count("*")
        most = 0 if 2 * stars > len(w) - stars else _reach(w)  # of a word that is masked for a third or more the rest must be right
        near = self.trie.near(w, most, True, "" if odd or w[0] == "*" else w[0] + _ALIKE.get(w[0], ""))
        if near and len(near[0]) > 2:
            return near[0], odd or near[1] > 0
        return w, False

    def unspaced(self, run: str) -> str:
        """The words of a run of single letters: the split into known words that leaves the fewest letters over."""
        letters = run.replace(" ", "")
        low = letters.lower()
        n = len(low)
        cost, back = [0.0] + [1e9] * n, [0] * (n + 1)
        for i in range(n):
            for j in range(i + 1, min(n, i + self.longest) + 1):
                w = low[i:j]
                known = w in self.lexical or w in self.plain or w in self.ordinary or w.translate(_LEET) in self.lexical
                c = cost[i] + (0.6 - 0.02 * (j - i) * (w in self.lexical) if known and (j - i > 1 or w in "aiyeouà") else 1.0 + 0.9 * (j - i - 1))
                if c < cost[j]:
                    cost[j], back[j] = c, i
        out, at = [], n
        while at:
            out.append(letters[back[at] : at])
            at = back[at]
        return " ".join(reversed(out))

    def sentences(self, text: str) -> Iterator[tuple[str, list[tuple[str, int]], list[tuple[str, bool]], bool]]:
        """(lower case, words with places, words in plain spelling, whether letters stood apart) of the sentences of a text."""
        clean = latin_words(fold_keep(text))
        for sentence in _BOUND.split(_TAG.sub(" ", clean)):
            if not sentence or not sentence.strip():
                continue
            if "*" in sentence:
                sentence = _STRESS.sub(r"\2", sentence)
            spaced = bool(_SPACED.search(sentence))
            low = (_SPACED.sub(lambda m: self.unspaced(m.group()), sentence) if spaced else sentence).lower()
            raw = self.tokens(low)
            yield low, raw, [self.spell(w) for w, _ in raw], spaced

    def windows(self, text: str) -> list[dict]:
        """The windows of a text: its words in plain spelling, the classes of the terms in it, disguise, quotation, place."""
        out = []
        for low, raw, spelt, spaced in self.sentences(text):
            words = [w for w, _ in spelt]
            hits = []
            for i, w in enumerate(words):
                for run, kind in self.runs.get(w, ()):
                    if tuple(words[i : i + len(run)]) == run:
                        hits.append((i, i + len(run), kind, any(d for _, d in spelt[i : i + len(run)])))
            if not hits:
                continue
            hits.sort()
            groups: list[list] = []
            opened, closed, plain = ([m.start() for m in p.finditer(low)] for p in _QUOTES)
            end = 0
            for h in hits:
                if groups and h[0] - end <= REACH:
                    groups[-1].append(h)
                else:
                    groups.append([h])
                    end = 0
                end = max(end, h[1])
            for g in groups:
                a, b = max(0, g[0][0] - REACH), min(len(words), max(x[1] for x in g) + REACH)
                place = raw[g[0][0]][1]
                quoted = bisect_left(opened, place) > bisect_left(closed, place) or bisect_left(plain, place) % 2 == 1
                odd = spaced or any(h[3] for h in g)
                out.append({"words": words[a:b], "kinds": Counter(h[2] for h in g), "odd": odd, "quoted": quoted})
        return out


def fold_keep(text: str) -> str:
    """``text`` without invisible characters, in compatibility form, its case kept."""
    return INVISIBLE.sub("", unicodedata.normalize("NFKC", text))


_CUES = {k: frozenset(v.split()) for k, v in CUES.items()}


def features(window: dict) -> tuple[np.ndarray, np.ndarray]:
    """(named features, places of the hashed n-grams) of a window."""
    kinds, words = window["kinds"], window["words"]
    x = np.zeros(len(NAMES))
    x[0] = 1
    for k in CLASSES:
        x[NAMES.index(k)] = min(2 if k != "learned" else 1, kinds[k])
    x[NAMES.index("several")] = min(2, max(0, sum(kinds.values()) - kinds["learned"] - 1))
    x[NAMES.index("disguised")] = window["odd"]
    for k, own in _CUES.items():
        x[NAMES.index(k)] = any(w in own for w in words)
    x[NAMES.index("quoted")] = window["quoted"]
    grams = {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}
    return x, np.asarray(sorted({zlib.crc32(g.encode()) >> (32 - BITS) for g in grams}), np.int64)


class Model:
    """The logistic model over windows."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.named = np.asarray(list(PRIOR.values()))
        self.hashed = np.zeros(1 << BITS)

    def window_score(self, window: dict) -> float:
        x, at = features(window)
        return float(1 / (1 + np.exp(-(x @ self.named + self.hashed[at].sum()))))

    def score(self, text: str | None) -> tuple[float, str | None, int]:
        """(score, class, windows) of a text: the highest of its windows' scores; 0 where no term is found."""
        if not text:
            return 0.0, None, 0
        windows = self.lexicon.windows(text)
        best = max(((self.window_score(w), w) for w in windows), key=lambda x: x[0], default=(0.0, None))
        kind = best[1]["kinds"].most_common(1)[0][0] if best[1] else None
        return round(best[0], 6), kind, len(windows)

    def fit(self, posts: list[tuple[list[dict], int]], rounds: int = 4, steps: int = 150, rate: float = 0.3) -> None:
        """Fits on (windows, label) of posts: a positive post's highest window is positive, all windows of a negative one negative."""
        posts = [(w, y) for w, y in posts if w]
        if not posts:
            return
        rows = [(features(w), k, y) for k, (ws, y) in enumerate(posts) for w in ws]
        x = np.stack([f[0] for f, _, _ in rows])
        at = np.concatenate([f[1] for f, _, _ in rows])
        row = np.repeat(np.arange(len(rows)), [len(f[1]) for f, _, _ in rows])
        post = np.asarray([k for _, k, _ in rows])
        label = np.asarray([y for _, _, y in rows], float)
        start = self.named.copy()
        g1, g2 = np.full_like(self.named, 1e-6), np.full_like(self.hashed, 1e-6)
        for turn in range(rounds):
            z = x @ self.named + np.bincount(row, self.hashed[at], len(rows))
            top = np.full(len(posts), -np.inf)
            np.maximum.at(top, post, z)
            use = (label == 0) | (z >= top[post] - 1e-9)
            if turn > 1:  # labels that the model is sure are wrong no longer count
                use &= np.where(label == 0, top[post] < 3, top[post] > -3)
            weight = use.astype(float)
            for _ in range(steps):
                z = x @ self.named + np.bincount(row, self.hashed[at], len(rows))
                e = (1 / (1 + np.exp(-z)) - label) * weight
                d1 = x.T @ e + 2.0 * (self.named - start)
                d2 = np.bincount(at, e[row], len(self.hashed)) + 0.4 * self.hashed
                g1 += d1**2
                g2 += d2**2
                self.named -= rate * d1 / np.sqrt(g1)
                self.hashed -= rate * d2 / np.sqrt(g2)


def learned_terms(posts: list[tuple[str, int]], lexicon_: Lexicon, seen: int = SEEN) -> list[tuple[str, ...]]:
    """Runs of up to WORDS words that ``seen`` or more of the abusive posts hold and others far less often.

    Of runs within each other the one that tells most is taken.  They only say where to look: whether a place is abuse is for
    the model of its window.
    """
    base = sum(y for _, y in posts) / max(1, len(posts))

    def runs(text: str, among: Counter | None = None) -> set[tuple[str, ...]]:
        out = set()
        for _, _, spelt, _ in lexicon_.sentences(text):
            w = [x for x, _ in spelt]
            for n in range(1, WORDS + 1):
                own = zip(*(w[i:] for i in range(n)), strict=False)
                out.update(own if among is None else (r for r in own if r in among))
        return out

    bad = Counter(r for t, y in posts if y and t for r in runs(t))
    bad = Counter({r: n for r, n in bad.items() if n >= seen and (len(r) > 1 or len(r[0]) > 3)})
    good = Counter(r for t, y in posts if not y and t for r in runs(t, bad))
    gain: dict[tuple[str, ...], float] = {}
    for r, n in bad.items():
        share = n / (n + good[r])
        if share >= (SHARE if len(r) > 1 else 2 * SHARE) and share > base:
            gain[r] = n * math.log(share / base) + (good[r] * math.log((1 - share) / (1 - base)) if good[r] else 0.0)
    out: set[tuple[str, ...]] = set()
    within: set[tuple[str, ...]] = set()  # parts of those taken
    for r in sorted((r for r, g in gain.items() if g >= LIKELIER), key=lambda r: (-gain[r], r)):
        inner = {r[i : i + m] for m in range(1, len(r) + 1) for i in range(len(r) - m + 1)}
        if r not in within and not inner & out:
            out.add(r)
            within |= inner
    return sorted(out)


def train(posts: list[tuple[str, int]], terms: dict[str, list[str]] | None = None) -> Model:
    """The model fitted on (text, label) pairs, with the terms learned from them.

    Words that occur in several unabusive posts aren't taken for misspelled terms.
    """
    seen = Counter(w for t, y in posts if not y and t for w in set(Lexicon.words(t)))
    ordinary = frozenset(w for w, n in seen.items() if n >= 2)
    start = Lexicon(terms, ordinary)
    model = Model(Lexicon(terms, ordinary, learned_terms(posts, start)))
    model.fit([(model.lexicon.windows(t), y) for t, y in posts if t])
    model.lexicon.held = {}
    return model


def score(posts: DataFrame, labels: DataFrame, key: str, text: str, keep: list[str], label_key: str, label: str, version: str | None = None, sample: int = SAMPLE, terms: dict[str, list[str]] | None = None) -> DataFrame:
    """(key, keep..., score, kind, windows): how abusive each row's text is (0 to 1), the main class of its worst window, and its windows.

    A text in which no term of the lexicon is found, in any disguise, scores 0; so do null, empty and blank texts.  Rows stay
    as they are; other columns are dropped; an empty table gives an empty result.  ``labels`` (key, 0 or 1) may repeat a key:
    the majority counts, ties as abusive; rows with a null are left out, and without labels the starting weights are used.
    At most ``sample`` labelled posts are fitted on, each by its last text by the column ``version`` (the greatest text without
    one).  ``terms`` is a lexicon of one's own.
    """
    spark = posts.sparkSession
    told = labels.where(F.col(label_key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(label_key).alias("_k")).agg((F.avg(label) >= 0.5).cast("int").alias("_y"))
    told = told.orderBy(F.xxhash64("_k")).limit(sample)  # bounded: SAMPLE rows
    own = posts.select(F.col(key).alias("_k"), F.col(version or text).alias("_v"), F.col(text).alias("_t")).join(F.broadcast(told), "_k")
    rows = current(own, "_k", ["_v"], "_t", "_y").where("_t is not null").collect()  # as many rows as labels
    model = train(sorted((r["_t"], r["_y"]) for r in rows), terms)
    sent = spark.sparkContext.broadcast(model)  # weights of a fixed size, the ordinary words of the sample

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for pdf in batches:
            out = pdf[[key, *keep]].copy()
            got = [own.score(t) for t in pdf["_text"]]
            out["score"], out["kind"], out["windows"] = [g[0] for g in got], [g[1] for g in got], [g[2] for g in got]
            yield out

    fields = ", ".join(f"`{c}` {posts.schema[c].dataType.simpleString()}" for c in [key, *keep])
    return spread(posts.select(key, *keep, F.col(text).alias("_text"))).mapInPandas(run, f"{fields}, score double, kind string, windows int")
