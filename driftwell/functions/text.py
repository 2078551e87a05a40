"""Text functions: cleaning, analysis, windows, body extraction, encoders."""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands between the words of any script: no letter, digit or mark on a letter; the same on Java's and RE2's engines.
SPLIT = r"[^\p{L}\p{N}\p{M}]+"


def clean_html(raw: Column) -> Column:
    """Markup removed: style and script blocks, comments, tags, the five basic entities, runs of blanks."""
    t = F.regexp_replace(raw, r"(?is)<style[^>]*>.*?</style>|<script[^>]*>.*?</script>", "")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(t, r"[ \t\n\r]+", " "), r"^ | $", "")


def normalise_text(text: Column) -> Column:
    """Entities decoded and NFKC applied, which Spark has no function for."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", html.unescape(x)))

    return run(text)


def full_clean(raw: Column, block_space: bool = False) -> Column:
    """The complete cleaner: ``clean_html`` without its entity chain, all entities, NFKC, runs of blanks."""
    t = F.regexp_replace(raw, r"(?is)<style[^>]*>.*?</style>|<script[^>]*>.*?</script>|<!--.*?-->", "")
    t = F.regexp_replace(t, r"<[^>]*>", " " if block_space else "")
    return F.trim(F.regexp_replace(normalise_text(t), r"\s+", " "))


def display_text(raw: Column) -> Column:
    """Text that keeps paragraphs: block ends become blank lines, list items get a star."""
    t = F.regexp_replace(raw, r"(?is)<style[^>]*>.*?</style>|<script[^>]*>.*?</script>|<!--.*?-->", "")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>", "\n")
    t = F.regexp_replace(t, r"(?i)<li[^>]*>", "\n* ")
    t = F.regexp_replace(t, r"(?i)</(p|div|h[1-6]|blockquote|ul|ol|pre|table)>", "\n\n")
    t = normalise_text(F.regexp_replace(t, r"<[^>]*>", ""))
    return F.trim(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def simple_terms(text: Column) -> Column:
    """The words of a text in order, in lower case (the ``simple`` analyser)."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), lambda w: F.length(w) > 0)


#: English stop words of the text search that is matched.
STOP = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom
    this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into
    through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such
    no nor not only own same so than too very s t can will just don should now""".split()
)

_VOWEL = "aeiouy"


class Stemmer:
    """The public English (Porter2) stemming rules, applied to one word at a time."""

    DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
    WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
    KEEP = frozenset("sky news howe atlas cosmos bias andes".split())
    LATE = frozenset("inning outing canning herring earring proceed exceed succeed".split())
    STEP2 = (
        ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"),
        ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"),
    )
    STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
    STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")

    def __init__(self):
        self.held: dict[str, str] = {}

    def __call__(self, word: str) -> str:
        got = self.held.get(word)
        if got is None:
            if len(self.held) > 200_000:
                self.held.clear()
            got = self.held[word] = self._stem(word)
        return got

    @staticmethod
    def _region(w: str, start: int) -> int:
        for i in range(start + 1, len(w)):
            if w[i] not in _VOWEL and w[i - 1] in _VOWEL:
                return i + 1
        return len(w)

    @staticmethod
    def _short_end(w: str) -> bool:
        if len(w) == 2:
            return w[0] in _VOWEL and w[1] not in _VOWEL
        return len(w) > 2 and w[-1] not in _VOWEL + "wxY" and w[-2] in _VOWEL and w[-3] not in _VOWEL

    def _stem(self, w: str) -> str:
        if len(w) <= 2:
            return w
        if w in self.WHOLE:
            return self.WHOLE[w]
        if w in self.KEEP:
            return w
        w = w.lstrip("'")
        if w.startswith("y"):
            w = "Y" + w[1:]
        w = re.sub(r"(?<=[aeiouy])y", "Y", w)
        r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
        r1 = self._region(w, 0) if r1 is None else r1
        r2 = self._region(w, r1)
        for end in ("'s'", "'s", "'"):
            if w.endswith(end):
                w = w[: -len(end)]
                break
        # step 1a
        if w.endswith("sses"):
            w = w[:-2]
        elif w.endswith(("ied", "ies")):
            w = w[:-2] if len(w) > 4 else w[:-1]
        elif w.endswith(("us", "ss")):
            pass
        elif w.endswith("s") and any(c in _VOWEL for c in w[:-2]):
            w = w[:-1]
        if w in self.LATE:
            return w.lower()
        # step 1b
        for end in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
            if w.endswith(end):
                stem = w[: -len(end)]
                if end in ("eed", "eedly"):
                    if len(stem) >= r1:
                        w = stem + "ee"
                elif any(c in _VOWEL for c in stem):
                    w = stem
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w.endswith(self.DOUBLE):
                        w = w[:-1]
                    elif len(w) <= r1 and self._short_end(w):
                        w += "e"
                break
        # step 1c
        if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWEL:
            w = w[:-1] + "i"
        # step 2
        for end, new in self.STEP2:
            if w.endswith(end):
                if len(w) - len(end) >= r1:
                    w = w[: -len(end)] + new
                break
        else:
            if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
                w = w[:-1]
            elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
                w = w[:-2]
        # step 3
        for end, new in self.STEP3:
            if w.endswith(end):
                if len(w) - len(end) >= r1:
                    w = w[: -len(end)] + new
                break
        else:
            if w.endswith("ative") and len(w) - 5 >= r2:
                w = w[:-5]
        # step 4
        for end in self.STEP4:
            if w.endswith(end):
                if len(w) - len(end) >= r2:
                    w = w[: -len(end)]
                break
        else:
            if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
                w = w[:-3]
        # step 5
        if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not self._short_end(w[:-1]))):
            w = w[:-1]
        elif w.endswith("l") and len(w) - 1 >= r2 and w[-2:-1] == "l":
            w = w[:-1]
        return w.lower()


_stem = Stemmer()
_SPLIT = regex.compile(r"[^\p{L}\p{N}\p{M}']+")
_WORDS = regex.compile(SPLIT)


def simple_words(text: str | None) -> list[str]:
    """The words of a text in order, in lower case."""
    return [w for w in _WORDS.split((text or "").lower()) if w]


def english_positions(text: str | None) -> list[tuple[str, int]]:
    """(lexeme, position) of the words of a text that aren't stop words; positions count every word, from 1."""
    words = [w.strip("'") for w in _SPLIT.split((text or "").lower())]
    return [(_stem(w), i) for i, w in enumerate((w for w in words if w), 1) if w not in STOP]


def may_hold(lexeme: str, text: Column) -> Column:
    """Whether a text can hold a word with this English stem: endings change its last letter at most, but for the listed words."""
    low = F.lower(text)
    own = [lexeme[:-1], *(w for w, s in Stemmer.WHOLE.items() if s == lexeme)]
    return F.exists(F.array(*[F.lit(x) for x in own]), lambda x: F.contains(low, x))


def english_terms(text: Column) -> Column:
    """The ``english`` analyser."""

    @F.pandas_udf("array<struct<lexeme:string,pos:int>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"lexeme": a, "pos": b} for a, b in english_positions(t)])

    return run(text)


def windows(text: Column, size: int = 512, overlap: int = 64) -> Column:
    """Arrays of the words of overlapping windows; the last one reaches the end, a text of at most ``size`` words is one."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\r]+"), lambda w: F.length(w) > 0)
    step = size - overlap
    n = F.size(words)
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / F.lit(float(step))).cast("int") * step)
    return F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda s: F.slice(words, s + 1, size))


def body(post_type: Column, c: dict[str, Column]) -> Column:
    """The raw body of a feed post by its type; null for others and where all parts are empty."""
    full = lambda x: F.nullif(x, F.lit(""))
    lines = F.transform(F.coalesce(c["dialogue"], F.array()), lambda d: F.concat(F.coalesce(d["label"], F.lit("")), F.lit(" "), F.coalesce(d["phrase"], F.lit(""))))
    return (
        F.when(post_type == "text", F.coalesce(full(c["body"]), full(c["title"])))
        .when(post_type == "photo", full(c["caption"]))
        .when(post_type == "quote", full(c["text"]))
        .when(post_type == "link", F.coalesce(full(c["description"]), full(c["title"])))
        .when(post_type == "answer", F.concat(F.coalesce(c["question"], F.lit("")), F.lit("\n"), F.coalesce(c["answer"], F.lit(""))))
        .when(post_type == "chat", full(F.array_join(lines, "\n")))
    )


def image_urls(photos: Column) -> Column:
    """The original address of each photo that has one."""
    return F.filter(F.transform(F.coalesce(photos, F.array()), lambda p: p["original_size"]["url"]), lambda u: u.isNotNull() & (u != ""))


def blocked(text: Column, terms: list[str]) -> Column:
    """Whether a text contains any of the terms, whatever the case."""
    return F.exists(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(F.lower(F.coalesce(text, F.lit(""))), t)) if terms else F.lit(False)


def hash_encode(texts: list[str | None], size: int = 384) -> np.ndarray:
    """Unit rows of signed hashed words and word pairs: a deterministic stand-in for a sentence encoder."""
    out = np.zeros((len(texts), size))
    for i, t in enumerate(texts):
        words = re.findall(r"\w+", (t or "").lower())
        for g in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]:
            h = zlib.crc32(g.encode())
            out[i, h % size] += 1 if h & 0x80000000 else -1
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, n, out=out, where=n > 0).astype(np.float32)


def encode(rows: DataFrame, text: str, out: str = "embedding", encoder=hash_encode, size: int = 384) -> DataFrame:
    """``rows`` with the vector of a text by any encoder (a function of a list of texts), an Arrow batch at a time."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(encoder([t if isinstance(t, str) else None for t in s], size)))

    return rows.withColumn(out, run(F.col(text)))


#: Common words that tell languages apart for the quick guess.
GUESS = {
    "en": "the and is of to in that it was for with as on are this but not have from they you he she his her",
    "es": "el la los las una que de en es y por con para no se del al como pero más muy",
    "fr": "le la les des une est et en que qui dans pour pas sur du au avec ne se ce il",
    "de": "der die das und ist nicht ein eine zu den mit auf für von dem im es sich auch",
    "pt": "o os as um uma do da em não para com por mas muito na no eu isso que ao foi",
    "it": "il di che è per non una sono ma nel della con del gli ho mi più ancora",
    "ru": "и в не на я что он с как это по но из у за то все так мне его",
}


def guess_language(text: Column) -> Column:
    """The language of most common words among a few, ``und`` for empty texts and ties at nothing (for full detection use a model)."""
    words = simple_terms(text)
    shared = lambda own: F.size(F.filter(words, lambda w: w.isin(own)))
    votes = [F.struct(shared(own.split()).alias("n"), F.lit(-k).alias("k"), F.lit(lang).alias("lang")) for k, (lang, own) in enumerate(GUESS.items())]
    best = F.greatest(*votes)
    return F.when(best["n"] > 0, best["lang"]).otherwise("und")
