"""Languages of documents and of their passages (problem 4) by rank-order n-gram profiles.

A profile lists a language's most frequent n-grams by rank.  A text's own n-grams are ranked the same way; its distance to a
language is how far they are out of place there.  Profiles start from the seed texts below and are fitted on all texts.
Passages are found by giving every sentence (and, where a sentence turns, each part of it) the language that makes the whole
document cheapest: the sum of the out-of-place distances of its words, each ranked as a text of its own, and a cost for each
change.  The language of a passage is then decided by the out-of-place distance of the passage as a whole, or left open (und).
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftwell.llm.common import INVISIBLE, latin_words, spread
from driftwell.sources.store import cut

#: Seed texts: everyday sentences of each language.
SEED = {
    "en": """I have been thinking about this all week and I still do not know what to say. You can see the house from the road, but there is no
    way to get there without walking through the field. She told me that they would come back after the summer, when the weather is better and
    the children are out of school. Most people who live here work in the city and only return in the evening. If you want to make it yourself,
    take your time and read every page before you start. It was the first thing which they ever bought with their own money, and nobody could
    have known how much it would be worth. We were told that something had gone wrong, so each of us went home and waited for an answer. Thanks
    to everyone who wrote about the other one; this is just enough for now. What should he do with such a small piece of wood? His mother, her
    friends and my brother are always late. Please don't ask why it isn't here yet. Here are some more words from my last book.""",
    "es": """He estado pensando en esto toda la semana y todavía no sé qué decir. Desde la carretera se ve la casa, pero no hay manera de llegar
    sin cruzar el campo. Ella me dijo que volverían después del verano, cuando hace mejor tiempo y los niños no tienen clase. La mayoría de la
    gente que vive aquí trabaja en la ciudad y solo vuelve por la noche. Si quieres hacerlo tú mismo, tómate tu tiempo y lee cada página antes
    de empezar. Fue lo primero que compraron con su propio dinero, y nadie podía saber cuánto valdría. Nos dijeron que algo había salido mal,
    así que cada uno se fue a su casa a esperar una respuesta. Gracias a todos los que escribieron sobre el otro; esto es suficiente por ahora.
    ¿Qué debería hacer él con un trozo de madera tan pequeño? Su madre, sus amigas y mi hermano siempre llegan tarde. Por favor, no preguntes
    por qué no está aquí. Estas son algunas palabras más de mi último libro. Eres muy amable, ya lo sabes, y me gusta mucho. Hay que ir hoy.""",
    "fr": """J'ai pensé à cela toute la semaine et je ne sais toujours pas quoi dire. On voit la maison depuis la route, mais il n'y a pas moyen
    d'y aller sans traverser le champ. Elle m'a dit qu'ils reviendraient après l'été, quand il fait meilleur et que les enfants ne sont pas à
    l'école. La plupart des gens qui vivent ici travaillent en ville et ne rentrent que le soir. Si tu veux le faire toi-même, prends ton temps et
    lis chaque page avant de commencer. C'était la première chose qu'ils avaient achetée avec leur propre argent, et personne ne pouvait savoir
    combien elle vaudrait. On nous a dit que quelque chose s'était mal passé, alors chacun est rentré chez soi pour attendre une réponse. Merci à
    tous ceux qui ont écrit au sujet de l'autre ; c'est assez pour le moment. Que devrait-il faire avec un si petit morceau de bois ? Sa mère, ses
    amies et mon frère sont toujours en retard. S'il vous plaît, ne demandez pas pourquoi. Voici encore quelques mots de mon dernier livre. Tu es
    très gentil, vous le savez, et cela me plaît beaucoup. Il faut y aller aujourd'hui, parce que nous aussi sommes contents du résultat.""",
    "de": """Ich habe die ganze Woche darüber nachgedacht und weiß immer noch nicht, was ich sagen soll. Man sieht das Haus von der Straße aus, aber
    es gibt keinen Weg dorthin, ohne durch das Feld zu gehen. Sie hat mir gesagt, dass sie nach dem Sommer zurückkommen, wenn das Wetter besser
    ist und die Kinder keine Schule haben. Die meisten Leute, die hier wohnen, arbeiten in der Stadt und kommen erst am Abend wieder. Wenn du es
    selbst machen willst, nimm dir Zeit und lies jede Seite, bevor du anfängst. Es war das Erste, was sie von ihrem eigenen Geld gekauft hatten,
    und niemand konnte wissen, wie viel es wert sein würde. Man sagte uns, dass etwas schiefgegangen sei, also ging jeder nach Hause und wartete
    auf eine Antwort. Danke an alle, die über den anderen geschrieben haben; das reicht für jetzt. Was soll er mit einem so kleinen Stück Holz
    anfangen? Seine Mutter, ihre Freundinnen und mein Bruder kommen immer zu spät. Bitte frag nicht, warum es noch nicht da ist. Hier sind noch
    ein paar Wörter aus meinem letzten Buch. Du bist sehr nett, das weißt du, und es gefällt mir auch. Wir müssen heute gehen, weil er dich will.""",
    "pt": """Tenho pensado nisto a semana toda e ainda não sei o que dizer. Da estrada vê-se a casa, mas não há maneira de chegar lá sem atravessar
    o campo. Ela disse-me que voltariam depois do verão, quando o tempo está melhor e as crianças não têm aulas. A maioria das pessoas que vivem
    aqui trabalha na cidade e só volta à noite. Se você quer fazer isso sozinho, leve o seu tempo e leia cada página antes de começar. Foi a
    primeira coisa que compraram com o próprio dinheiro, e ninguém podia saber quanto valeria. Disseram-nos que alguma coisa tinha corrido mal,
    então cada um foi para casa esperar uma resposta. Obrigado a todos os que escreveram sobre o outro; isto é suficiente por agora. O que deveria
    ele fazer com um pedaço de madeira tão pequeno? A mãe dele, as amigas dela e o meu irmão chegam sempre tarde. Por favor, não pergunte por que
    não está aqui. Estas são mais algumas palavras do meu último livro. Você é muito gentil, já sabe, e eu gosto muito da sua avó. É preciso ir
    hoje, porque nós também estamos felizes com o resultado, embora faça frio em casa e não haja mais pão.""",
    "it": """Ho pensato a questo tutta la settimana e ancora non so che cosa dire. Dalla strada si vede la casa, ma non c'è modo di arrivarci senza
    attraversare il campo. Lei mi ha detto che sarebbero tornati dopo l'estate, quando il tempo è migliore e i bambini non hanno scuola. La maggior
    parte della gente che vive qui lavora in città e torna solo la sera. Se vuoi farlo da solo, prenditi il tuo tempo e leggi ogni pagina prima di
    cominciare. Era la prima cosa che avevano comprato con i loro soldi, e nessuno poteva sapere quanto sarebbe valsa. Ci hanno detto che qualcosa
    era andato storto, così ognuno è andato a casa ad aspettare una risposta. Grazie a tutti quelli che hanno scritto dell'altro; questo basta per
    adesso. Che cosa dovrebbe fare lui con un pezzo di legno così piccolo? Sua madre, le sue amiche e mio fratello sono sempre in ritardo. Per
    favore, non chiedere perché non è ancora qui. Ecco altre parole del mio ultimo libro. Sei molto gentile, lo sai, e mi piace anche questo. Oggi
    bisogna andare, perché anche noi siamo contenti del risultato, e gli altri degli amici della zia sono nella piazza con il cane.""",
    "ru": """Я думал об этом всю неделю и всё ещё не знаю, что сказать. С дороги виден дом, но туда нельзя попасть, не пройдя через поле. Она сказала
    мне, что они вернутся после лета, когда погода станет лучше и у детей не будет школы. Большинство людей, которые здесь живут, работают в городе
    и приходят только вечером. Если хочешь сделать это сам, не торопись и прочитай каждую страницу, прежде чем начать. Это была первая вещь, которую
    они купили на свои деньги, и никто не мог знать, сколько она будет стоить. Нам сказали, что что-то пошло не так, поэтому каждый пошёл домой ждать
    ответа. Спасибо всем, кто написал о другом; этого пока достаточно. Что ему делать с таким маленьким куском дерева? Его мать, её подруги и мой
    брат всегда опаздывают. Пожалуйста, не спрашивай, почему его ещё нет. Вот ещё несколько слов из моей последней книги.""",
    "ja": """一週間ずっとこのことを考えていましたが、まだ何を言えばいいのかわかりません。道から家が見えますが、畑を通らないと行けません。彼女は、夏が終わって
    天気がよくなり、子どもたちの学校が休みになったら戻ってくると言いました。ここに住んでいる人の多くは町で働いていて、夜にしか帰ってきません。自分で作りたいなら、
    時間をかけて、始める前にすべてのページを読んでください。それは自分のお金で最初に買ったものでした。だれもその値段を知りませんでした。何かがうまくいかなかったと
    言われたので、みんな家に帰って返事を待ちました。書いてくれたみなさん、ありがとう。今日はこれで十分です。こんな小さな木で何をすればいいのだろう。母も友だちも
    弟もいつも遅れて来る。どうしてまだここにないのか聞かないでください。とても好きだ。それだけではない。""",
}
LANGS = tuple(SEED)
#: n-grams in a profile, and the longest n-gram.
DEPTH, LONGEST = 1500, 4
#: Times that the seed texts count beside up to SEEDED texts that profiles are fitted on; beside more texts they count as many times more.
WEIGHT, SEEDED = 4, 4000
#: Words that are read at once when profiles are fitted.
AT_ONCE = 250_000
#: Confidence below which a passage is of no known language: how much nearer the best profile is than the next one.
SURE, UNKNOWN = 0.045, "und"
#: Cost of a change of language between sentences and inside one, in units of a word's rank distance.
BETWEEN, INSIDE = 9.0, 26.0
#: Characters of a quotation in pointed marks that counts as a title.
TITLE = 60
#: Letters that a passage needs to count as a sentence, and words (letters for scripts without spaces).
LETTERS, WORDS = 15, 3

#: Names that labels use beside the two-letter code.
NAMES = {
    "en": "eng english inglés anglais englisch", "es": "spa spanish español castellano espanol", "fr": "fra fre french français francais", "de": "deu ger german deutsch",
    "pt": "por portuguese português portugues", "it": "ita italian italiano", "ru": "rus russian русский", "ja": "jpn jap japanese 日本語 jp",
}
_NAMED = {w: k for k, v in NAMES.items() for w in [k, *v.split()]}
#: Labels that name no language.
NONE = frozenset("und unk unknown undefined undetermined none null nan na n/a zxx mul mis xx ?? ? - other".split())


def named(label: Column) -> Column:
    """``label_language`` of a column, an Arrow batch at a time; each label is read once."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        known = {x: label_language(x) for x in s.unique()}
        return s.map(known.get)

    return run(label)


def label_language(label: str | None) -> str | None:
    """The two-letter code that a label names (its own first letters for other languages), None if it names none."""
    if not isinstance(label, str):
        return None
    s = label.strip().lower()
    if s in NONE:
        return None
    for w in (s, re.split(r"[-_ (,;/]", s)[0]):
        if w in _NAMED:
            return _NAMED[w]
    head = re.split(r"[-_ (,;/]", s)[0]
    return head if head.isalpha() and 2 <= len(head) <= 20 and head not in NONE else None


_DROP = re.compile(
    r"```(?:[^`]|`(?!``))*+```|<[^<>\n]*+>|<(?:img|a|div|span)\b[^<>\n\"]*+(?:\"|$)|\{\|(?:[^|]|\|(?!\}))*+\|\}|\[\[(?:File|Image):[^\]]*+\]\]|!?\[([^\[\]\n]*+)\]\([^)\s]*+\)?|\\\[(?:[^\\]|\\(?!\]))*+\\\]|\\\((?:[^\\]|\\(?!\)))*+\\\)|\$[^$\n]+\$"
    r"|\\begin\{[a-z]+\*?\}|\\end\{[a-z]+\*?\}|\\[a-zA-Z]+|\b(?:https?://|www\.)\S+|(?<!\S)[^\s@]++@[^\s@.]++\.\S+|&(?:[a-zA-Z]{2,8}|#\d{1,6});|«[^»\n]{0,"
    + str(TITLE)
    + r"}»"
)
_MARK = re.compile(r"[<>`{\\$\[&@«]|://|www\.")
_LINK = re.compile(r"\[\[(?!File:|Image:)(?:[^\[\]|\n]*\|)?([^\[\]|\n]*)\]\]|\[https?://\S+ (?=[^\]\n]*\])", re.I)
_CODE, _STRONG = re.compile(r"[=;{}<>_|\\^*/+()\[\]]"), re.compile(r"[=;<>_\\^/+]")
_CODE_END = re.compile(r"(?:[;{]|(?:^|[\s;])\})\s*$")
_SOLID_WORD = re.compile(r"(?<!\S)[^\w\s]*[^\W\d_]+(?:['’\-][^\W\d_]+)*[^\w\s]*(?!\S)")
_BOUND = re.compile(r"(?<=[.!?…])[\"”“»)\]]*\s+|(?<=[。！？])|\n+|\r")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_LETTERS = re.compile(rf"(?:[^\W\d_][\W\d_]*){{{LETTERS}}}")
_KANA = re.compile(r"[\u3040-\u30ff\u4e00-\u9fff]")
_HANGUL = re.compile(r"[\uac00-\ud7af]")
_SYLLABLES = re.compile(r"[\u3040-\u30ff]")
_FOREIGN = re.compile(r"[\u0370-\u058f]")
_ODD = re.compile(r"[013457@$*](?:(?=[^\W\d_])|(?<=[^\W\d_].))")
_ONES = re.compile(r" [^\W\d_] [^\W\d_](?!\w)")
_SPACED = re.compile(r"(?<!\w)(?:[^\W\d_] ){2,}[^\W\d_](?!\w)")
_STRETCH = re.compile(r"([^\W\d_])\1{2,}")
_LEET = str.maketrans("013457@$", "oieastas")
_MASK = re.compile(r"(?<=[^\W\d_])[013457@$*]+(?=[^\W\d_])|(?<![\w])[013457@$]+(?=[^\W\d_]{2})|(?<=[^\W\d_]{2})[013457@$]+(?!\w)")


#: Flags that ``form`` gives: enough letters; letters of scripts without blanks, or Korean ones; Japanese syllables.
LETTERED, WIDE, SYLLABIC = 1, 2, 4

Sub = Callable[[re.Pattern, Callable[[re.Match], str], str], str]


def plain(text: str, sub: Sub = lambda pattern, to, t: pattern.sub(to, t)) -> str:
    """``text`` without markup, links and quoted titles, with disguised letters made plain; ``sub`` does the replacements."""
    t = text if text.isascii() else sub(INVISIBLE, lambda m: "", text)
    if "[" in t:
        t = sub(_LINK, lambda m: m.group(1) or "", t)
    if _MARK.search(t):
        t = sub(_DROP, lambda m: f" {m.group(1)} " if m.group(1) else " ", t)
    if _FOREIGN.search(t):
        t = latin_words(t)
    if _ONES.search(t):
        t = sub(_SPACED, lambda m: m.group().replace(" ", ""), t)
    if _ODD.search(t):
        t = sub(_MASK, lambda m: m.group().translate(_LEET).replace("*", ""), t)
    return sub(_STRETCH, lambda m: m.group(1), t)


def _pieces(low: str) -> Iterator[tuple[int, str]]:
    """(place, text) of each sentence or line of a plain text in lower case; code and formulas are left out."""
    code = bool(_CODE.search(low))
    at = 0
    for m in [*_BOUND.finditer(low), None]:
        s = low[at : m.start()] if m else low[at:]
        if s and not (code and _is_code(s)):
            yield at, s
        at = m.end() if m else at


def _is_code(s: str) -> bool:
    """Whether a line ends as code does, or marks of code are more than 7 % of it; brackets, bars and stars around plain words are no such marks."""
    if _CODE_END.search(s):
        return True
    if s.lstrip().startswith(("*", "=", "|", "(", "[", "#")):
        return False
    most = 0.07 * (len(s) - s.count(" "))
    if len(_CODE.findall(s)) <= most:
        return False
    return len(_STRONG.findall(s)) > most or len(_SOLID_WORD.findall(s)) < 0.7 * len(s.split())


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence or line of a text, in lower case; code and formulas are left out."""
    return [words for _, s in _pieces(plain(text).lower()) if (words := _WORD.findall(s))]


def placed(text: str) -> tuple[list[list[str]], list[tuple[int, int]]]:
    """(what ``sentences`` gives, (start, end) in ``text`` of every word of it in order)."""
    own: list[int] | None = None  # where each character of the plain text stands, once that differs

    def sub(pattern: re.Pattern, to: Callable[[re.Match], str], t: str) -> str:
        nonlocal own
        found = list(pattern.finditer(t))
        if not found:
            return t
        places = own if own is not None else range(len(t))
        parts, at, last = [], [], 0
        for m in found:
            new, old = to(m), m.group()
            parts += [t[last : m.start()], new]
            at += places[last : m.start()]
            if len(new) == len(old):
                at += places[m.start() : m.end()]
            else:  # what is kept stands where it stood, else letter after letter
                kept = new.strip()
                k = old.find(kept) - (len(new) - len(new.lstrip())) if kept and kept in old else 0
                at += [places[m.start() + min(len(old) - 1, max(0, k + i))] for i in range(len(new))]
            last = m.end()
        own = [*at, *places[last:]]
        return "".join([*parts, t[last:]])

    t = plain(text, sub)
    low = t.lower()
    if len(low) != len(t):
        own = [a for a, c in zip(own if own is not None else range(len(t)), t, strict=True) for _ in c.lower()]
    split, spans = [], []
    for at, s in _pieces(low):
        found = list(_WORD.finditer(low, at, at + len(s)))
        if found:
            split.append([m.group() for m in found])
            spans += [m.span() for m in found]
    return split, spans if own is None else [(own[a], own[b - 1] + 1) for a, b in spans]


def form(text: str) -> int:
    """Flags of a text: 0 if it has fewer than LETTERS letters, else LETTERED, with WIDE and SYLLABIC for what its scripts are."""
    if not _LETTERS.search(text):
        return 0
    return LETTERED | WIDE * bool(_KANA.search(text) or _HANGUL.search(text)) | SYLLABIC * bool(_SYLLABLES.search(text))


def grams(word: str) -> list[str]:
    """The n-grams of a word between blanks, the blank alone left out, and one for the script of each Japanese or Cyrillic letter."""
    w = f" {word} "
    script = [] if word.isascii() else ["\0kana"] * sum("぀" <= c <= "ヿ" or "一" <= c <= "鿿" for c in word) + ["\0cyr"] * sum("Ѐ" <= c <= "ӿ" for c in word)
    return script + [w[i : i + n] for n in range(1, LONGEST + 1) for i in range(len(w) - n + 1) if w[i : i + n] != " "]


class Profiles:
    """Rank-order profiles of the languages.

    What a word contributes is kept: its row of ``cost`` (how far out its n-grams lie in each profile) and the numbers of its n-grams.
    """

    def __init__(self, counts: dict[str, Counter], depth: int = DEPTH):
        self.depth = depth
        best = {lang: [g for g, _ in sorted(counts[lang].items(), key=lambda x: (-x[1], x[0]))[:depth]] for lang in LANGS}
        self.number = {g: i for i, g in enumerate(sorted({g for own in best.values() for g in own}))}
        self.rank = np.full((len(self.number) + 1, len(LANGS)), depth, np.int64)  # the last row: n-grams of no profile
        for k, lang in enumerate(LANGS):
            self.rank[[self.number[g] for g in best[lang]], k] = np.arange(len(best[lang]))
        self._reach(2 * depth)
        self.forget()

    def _reach(self, most: int) -> None:
        """Makes ``out`` the distances of the n-grams of texts of up to ``most`` of them, at the place in ``start`` less the own rank."""
        far = np.log2(1.0 + np.arange(most + self.depth))
        self.most, self.farthest = most, far[self.depth]
        self.start = np.where(self.rank < self.depth, self.rank + most, self.depth + 2 * most)
        self.out = np.full(self.depth + 2 * most + 1, self.farthest)
        self.out[: most + self.depth] = far[np.abs(np.arange(most + self.depth) - most)]

    def forget(self) -> None:
        """Drops what is kept of words."""
        self.words: dict[str, int] = {}
        self.cost, self.grams = np.zeros((1024, len(LANGS))), []

    def ids(self, words: list[str]) -> np.ndarray:
        """The rows of words; new ones get theirs."""
        own = self.words
        got = list(map(own.get, words))
        if None in got:
            got = [i if (i := own.get(w)) is not None else self._new(w) for w in words]
        return np.array(got, np.int64)

    def _new(self, w: str) -> int:
        none = len(self.number)
        g = np.fromiter([self.number.get(x, none) for x in grams(w)], np.int32)
        got = self._out_of_place(np.sort(g)) * (math.sqrt(len(w)) if len(w) <= 9 else len(w) / 3)
        i = len(self.grams)
        if i == len(self.cost):
            self.cost = np.vstack([self.cost, np.zeros_like(self.cost)])
        self.cost[i] = got - got.min()
        self.grams.append(g)
        self.words[w] = i
        return i

    def distance(self, ids: np.ndarray) -> np.ndarray:
        """The out-of-place distance of words to each language, on a scale from 0 (every n-gram in its place) to 1."""
        every = np.concatenate([self.grams[i] for i in ids.tolist()])
        every.sort()
        return self._out_of_place(every) / self.farthest

    def _out_of_place(self, every: np.ndarray) -> np.ndarray:
        """The mean distance, as a logarithm, between the rank of each of the sorted n-grams here and in each profile."""
        first = np.empty(len(every), bool)
        first[0] = True
        np.not_equal(every[1:], every[:-1], out=first[1:])
        at = first.nonzero()[0]
        n = np.empty_like(at)
        np.subtract(at[:-1], at[1:], out=n[:-1])
        n[-1] = at[-1] - len(every)
        own = every[at[np.argsort(n, kind="stable")]]
        if len(own) > self.most:
            self._reach(len(own) + 1024)
        place = self.start.take(own, axis=0)
        place -= np.arange(len(own))[:, None]
        return np.add.reduce(self.out.take(place), axis=0) / len(own)

    def passages(self, split: list[list[str]]) -> list[tuple[int, int, np.ndarray]]:
        """(words, letters, rows of the words) of the passages of a text of these sentences, one language each, in order."""
        if len(self.words) > 150_000:
            self.forget()
        if not split:
            return []
        words = [w for s in split for w in s]
        ids = self.ids(words)
        total = np.zeros((len(ids) + 1, len(LANGS)))
        np.cumsum(self.cost[ids], axis=0, out=total[1:])
        starts, fresh, at = [], [], 0
        for s in split:
            starts.append(at)
            fresh.append(True)
            for t in self._turns(total, at, at + len(s)):
                starts.append(t)
                fresh.append(False)
            at += len(s)
        edge = np.asarray([*starts, at])
        cost = total[edge[1:]] - total[edge[:-1]]
        low = cost.argmin(axis=1)
        if len(starts) > 1 and (cost[:, low[0]] > cost.min(axis=1)).any():
            path = self._cheapest(cost, fresh)
        else:  # one language is cheapest everywhere
            path = [int(low[0])] * len(starts)
        out, lo = [], 0
        for i in range(1, len(path) + 1):
            if i == len(path) or path[i] != path[lo]:
                a, b = int(edge[lo]), int(edge[i])
                out.append((b - a, sum(map(len, words[a:b])), ids[a:b]))
                lo = i
        return out

    @staticmethod
    def _cheapest(cost: np.ndarray, fresh: list[bool]) -> list[int]:
        """The languages of the parts of a text that cost least, changes included."""
        best, back = cost[0].copy(), []
        for i in range(1, len(cost)):
            move = BETWEEN if fresh[i] else INSIDE / 3
            low = int(best.argmin())
            back.append(np.where(best <= best[low] + move, np.arange(len(LANGS)), low))
            best = np.minimum(best, best[low] + move) + cost[i]
        path = [int(best.argmin())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]

    def _turns(self, total: np.ndarray, a: int, b: int) -> list[int]:
        """Where the sentence from word a to word b turns from one language to another, if two parts fit clearly better than one."""
        out, todo = [], [(a, b)]
        while todo:
            a, b = todo.pop()
            if b - a < 2 * WORDS + 1:
                continue
            whole = (total[b] - total[a]).min()
            if whole < INSIDE:  # no cost is below zero, so no turn can save that much
                continue
            left = (total[a + WORDS : b - WORDS + 1] - total[a]).min(axis=1)
            right = (total[b] - total[a + WORDS : b - WORDS + 1]).min(axis=1)
            k = int((left + right).argmin())
            if whole - (left[k] + right[k]) >= INSIDE:
                out.append(a + WORDS + k)
                todo += [(a, a + WORDS + k), (a + WORDS + k, b)]
        return sorted(out)

    def segments(self, split: list[list[str]], form: int) -> list[tuple[str, float, int, int, int]]:
        """(language, confidence, letters, first word, word after the last) of the passages that hold a whole sentence, of a text of these sentences.

        Passages of one language that follow each other, with nothing but shorter ones between, are one.
        """
        if not form:
            return []
        wide, syllables = form & WIDE, form & SYLLABIC
        out: list[tuple[str, float, int, int, int]] = []
        at = 0
        for n, letters, ids in self.passages(split):
            at += n
            solid = wide and letters > 6 * n  # words that no blank divides
            if not solid and (n < WORDS or letters < LETTERS) or solid and letters < 6:
                continue
            d = self.distance(ids)
            order = np.argsort(d, kind="stable")
            sure = float(1 - d[order[0]] / max(1e-9, d[order[1]]))
            lang = LANGS[int(order[0])]
            if sure < SURE or lang == "ja" and not syllables:  # Chinese characters alone are no Japanese
                lang = UNKNOWN
            if out and out[-1][0] == lang:
                _, c, m, a, _ = out[-1]
                out[-1] = (lang, max(c, sure), m + letters, a, at)
            else:
                out.append((lang, sure, letters, at - n, at))
        return out

    def languages(self, text: str | None) -> list[tuple[str, float, int]]:
        """(language, confidence, letters) of each language that a whole sentence of the text is in, the one of most letters first."""
        return self.languages_of(sentences(text), f) if text and (f := form(text)) else []

    def languages_of(self, split: list[list[str]], form: int) -> list[tuple[str, float, int]]:
        """What ``languages`` gives, of a text that is read already."""
        found: dict[str, tuple[float, int]] = {}
        for lang, sure, letters, _, _ in self.segments(split, form):
            old = found.get(lang, (0.0, 0))
            found[lang] = (max(old[0], sure), old[1] + letters)
        return [(k, round(c, 4), n) for k, (c, n) in sorted(found.items(), key=lambda x: -x[1][1])]

    def spans(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """(start, end, language, confidence) of the passages of a text, in characters of the text as it is."""
        return self.spans_of(*placed(text), f) if text and (f := form(text)) else []

    def spans_of(self, split: list[list[str]], at: Sequence[Sequence[int]], form: int) -> list[tuple[int, int, str, float]]:
        """What ``spans`` gives, of a text that is read already."""
        return [(int(at[a][0]), int(at[b - 1][1]), lang, round(c, 4)) for lang, c, _, a, b in self.segments(split, form)]

    def sure(self, split: list[list[str]]) -> list[tuple[int, str, int]]:
        """(number of the language, word, times) of the words of those sentences of five words or more that one language is clearly nearest to."""
        if len(self.words) > 150_000:
            self.forget()
        split = [s for s in split if len(s) >= 5]
        if not split:
            return []
        n = np.fromiter(map(len, split), np.int64, len(split))
        ids = self.ids([w for s in split for w in s])
        cost = np.add.reduceat(self.cost[ids], np.cumsum(n) - n, axis=0)
        first, second = np.partition(cost, 1, axis=1)[:, :2].T
        clear = second - first > 0.6 * n
        kept = np.repeat(clear, n)
        names = list(self.words)
        times = np.bincount(np.repeat(cost.argmin(axis=1), n)[kept] * len(names) + ids[kept])
        seen = times.nonzero()[0]
        return [(k // len(names), names[k % len(names)], m) for k, m in zip(seen.tolist(), times[seen].tolist(), strict=True)]


def seed_counts() -> dict[str, Counter]:
    """n-gram counts of the seed texts."""
    return {lang: Counter(g for w in _WORD.findall(t.lower()) for g in grams(w)) for lang, t in SEED.items()}


def _start(texts: int, weight: int) -> Iterator[tuple[int, str, int]]:
    """(number of the language, n-gram, count) of the seed texts beside ``texts`` texts with words; an n-gram of theirs counts SEEDED."""
    for k, own in enumerate(seed_counts().values()):
        for g, n in own.items():
            yield k, g, n * weight * max(texts, SEEDED)


def _spelled(words: Iterable[tuple[int, str, int]]) -> Counter:
    """The counts of (number of the language, n-gram) of counted words."""
    out: Counter = Counter()
    for k, w, n in words:
        for g in grams(w):
            out[k, g] += n * SEEDED
    return out


def _profiles(counts: Iterable[tuple[int, str, int]]) -> Profiles:
    own: dict[str, Counter] = {k: Counter() for k in LANGS}
    for k, g, n in counts:
        own[LANGS[k]][g] += n
    return Profiles(own)


def fit(texts: list[str], rounds: int = 2, weight: int = WEIGHT) -> Profiles:
    """Profiles of the seed texts and of the sentences of ``texts`` that the profiles so far are sure of; texts of fewer than LETTERS letters hold none."""
    read = [own for t in texts if t and form(t) and (own := sentences(t))]
    split = [s for own in read for s in own]
    seed = list(_start(len(read), weight))
    got = Profiles(seed_counts())
    for _ in range(rounds):
        got = _profiles([*seed, *[(k, g, n) for (k, g), n in _spelled(got.sure(split)).items()]])
    return got


def _sentences(stored: str) -> list[list[str]]:
    return [s.split(" ") for s in stored.split("\n")] if stored else []


def _read(docs: DataFrame, key: str, text: str, keep: list[str], places: bool) -> DataFrame:
    """(key, keep..., _words, _form, _at): each text read once, kept in the shared folder.

    _words: the words of its sentences, a line each (empty if there are none); _form: its ``form``; _at: where its words stand, if ``places``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words, forms, at = [], [], []
            for t in pdf["_text"]:
                f = form(t) if isinstance(t, str) else 0
                split, own = ([], None) if not f else placed(t) if places else (sentences(t), None)
                words.append("\n".join([" ".join(s) for s in split]))
                forms.append(f)
                at.append(np.asarray(own, np.int32).tobytes() if own else None)
            got = pdf[[key, *keep]].copy()
            got["_words"] = pd.Series(words, index=pdf.index, dtype=object)
            got["_form"] = np.asarray(forms, np.int32)
            got["_at"] = pd.Series(at, index=pdf.index, dtype=object)
            yield got

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in [key, *keep])
    return cut(spread(docs.select(key, *keep, F.col(text).alias("_text"))).mapInPandas(run, f"{fields}, _words string, _form int, _at binary"))


def _counter(sent: Broadcast) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A function that gives, for batches of read texts, what ``Profiles.sure`` gives of AT_ONCE words at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        profiles, split, held = sent.value, [], 0
        for stored in itertools.chain((x for pdf in batches for x in pdf["_words"]), [""]):
            own = _sentences(stored)
            split += own
            held += sum(map(len, own))
            if held >= AT_ONCE or not own:
                yield pd.DataFrame(profiles.sure(split), columns=["lang", "word", "n"])
                split, held = [], 0

    return run


def _fit_all(read: DataFrame, rounds: int = 2, weight: int = WEIGHT) -> Profiles:
    """What ``fit`` gives for all texts that were read; only the n-grams of the profiles come to the driver."""
    spark = read.sparkSession
    read = read.where("_words != ''").select("_words")
    texts = read.count()
    got = Profiles(seed_counts())
    kind = "lang int, gram string, n long"
    seed = spark.createDataFrame(list(_start(texts, weight)), kind)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = _spelled(zip(pdf["lang"].tolist(), pdf["word"], pdf["n"].tolist(), strict=True))
            yield pd.DataFrame([(k, g, n) for (k, g), n in own.items()], columns=["lang", "gram", "n"])

    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(got)
        words = read.mapInPandas(_counter(sent), "lang int, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
        counts = words.mapInPandas(spell, kind).unionAll(seed).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        got = _profiles(counts.withColumn("_place", place).where(F.col("_place") <= DEPTH).select("lang", "gram", "n").collect())
        sent.unpersist()
    return got


def _run(docs: DataFrame, key: str, text: str, keep: list[str], places: bool, fn: Callable, out: str, kind: str) -> DataFrame:
    read = _read(docs, key, text, keep, places)
    sent = docs.sparkSession.sparkContext.broadcast(_fit_all(read))  # a few thousand n-grams for each language

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        profiles = sent.value
        for pdf in batches:
            got = pdf[[key, *keep]].copy()
            got[out] = [fn(profiles, _sentences(w), at, f) for w, f, at in zip(pdf["_words"], pdf["_form"].tolist(), pdf["_at"], strict=True)]
            yield got

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in [key, *keep])
    return read.mapInPandas(run, f"{fields}, {out} {kind}")


def detect(docs: DataFrame, key: str, text: str, keep: list[str] | None = None) -> DataFrame:
    """(key, keep..., languages): the languages of each row's text, an array of (lang, confidence, letters), main language first.

    A language counts if a whole sentence (WORDS words and LETTERS letters) is in it; quoted titles, links, code and markup
    don't count.  Passages that no profile is clearly nearest to (SURE) are und.  Null, empty and blank texts and texts of fewer
    than LETTERS letters get an empty array.  Rows stay as they are; other columns are dropped; an empty table gives an empty result.

    Profiles are fitted on the sentences of all rows.  The words of each text are kept in the shared folder, so each text is read once.
    """
    fn = lambda profiles, split, at, form: [{"lang": a, "confidence": b, "letters": c} for a, b, c in profiles.languages_of(split, form)]
    return _run(docs, key, text, keep or [], False, fn, "languages", "array<struct<lang:string,confidence:double,letters:long>>")


def segment(docs: DataFrame, key: str, text: str, keep: list[str] | None = None) -> DataFrame:
    """(key, keep..., segments): the passages of each row's text, an array of (start, end, lang, confidence) in order.

    Offsets are characters of the text as it is, end exclusive, from a passage's first word to its last.  What counts as a
    passage, und, the treatment of null, empty and short texts, and the fit are those of ``detect``.
    """

    def fn(profiles: Profiles, split: list[list[str]], at: bytes | None, form: int) -> list[dict]:
        places = np.frombuffer(at or b"", np.int32).reshape(-1, 2)
        return [{"start": a, "end": b, "lang": c, "confidence": d} for a, b, c, d in profiles.spans_of(split, places, form)]

    return _run(docs, key, text, keep or [], True, fn, "segments", "array<struct<start:int,end:int,lang:string,confidence:double>>")
