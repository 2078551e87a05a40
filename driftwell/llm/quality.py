"""Per-document text quality statistics (problem 10).

Statistics are computed a batch at a time over the flat array of all its lines, then folded to documents; fixed thresholds
give every line a form (prose, list, table or junk) and every failed rule of a document a recorded reason.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.llm.common import spread

#: Frequent function words of English, Spanish, French, German, Portuguese, Italian and Russian.
COMMON = frozenset(
    """
    the be to of and that have with a in is it for on was as at by i you not are this but from they or an my we had were her she he which me so
    el la los las un una de que y en no se por con para es lo mi pero muy está del al como más su todavía sin eso ha
    le les une des et est dans pour pas qui sur ne plus avec il je au ce cela mais son ma ai du même si en
    der die das und ist nicht ein eine zu den mit auf für von dem im es sich auch als war ich wie am noch aber dass so bin wir
    o os as um uma do da em não para com por mas muito na no eu isso ao foi ainda é
    di il che è per non una sono ma nel della con del gli ho mi più ancora anche questo
    и в не на я что он с как это по но из у за то все так мне его мой к этого же было потому
    """.split()
)

#: Thresholds of the rules; those marked * are published for web corpora and kept as they are.
LIMITS = {
    "mean_word_low": 3.0,  # *
    "mean_word_high": 10.0,  # *
    "symbol_ratio": 0.1,  # *
    "bullet_lines": 0.9,  # *
    "alphabetic_words": 0.8,  # *
    "common_words": 2,  # *
    "ellipsis_lines": 0.3,  # *
    "least_words": 50,  # *
    "cjk": 0.3,  # share of the letters above which a text is written without blanks, so that its words can't be counted
    "not_prose": 0.5,  # TESTDATA: more than half of the characters
}
#: Rules whose failure makes a text no natural prose.  Published ones count for texts of ``least_words`` words or more, as they
#: were made for such, and where words stand between blanks; ellipses are recorded alone, as they fail prose that trails off.
DECIDING = ("mean_word", "symbols", "bullets", "alphabetic", "common_words", "list", "table", "junk", "not_prose")

_WORDS = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_CJK = r"[\p{Hiragana}\p{Katakana}\p{Han}\p{Hangul}\p{Thai}]"
_COUNTS = {
    "digits": r"\p{N}",
    "spaces": r"\s",
    "marks": r"[,;:.!?…'\"“”„«»()\-–—。、！？「」『』：]",
    "cjk": _CJK,
    "words": r"\S+",
    "lettered": r"\S*\p{L}\S*",
    "symbols": r"#|\.\.\.|…",
    "wordlike": r"(?:^|[\s\"“„«(¿¡'’])\p{L}[\p{L}'’\-]*\p{L}?(?:$|[\s,;:.!?…\"”“»)'’])",
    "bars": r"\|",
    "tabs": r"\t",
    "semis": r";",
    "commas": r"[,、，]",
    "tight": r",\S",
    "gaps": r"\S[ \x{00a0}]{2,}",
    "dots": r" · | \| | » | • ",
    "tags": r"(?:^|\s)#[\p{L}\p{N}_\-]+",
    "links": r"(?:https?://|www\.)\S+",
    "ends": r"[.!?…。！？][\"”“»'’)\]]*(?:\s|$)",
}
_FLAGS = {
    "bullet": r"^\s*(?:[-*+•◦▪‣·☐☑☒✓✔]|\(?\d{1,4}[.)]|[a-zA-Z][.)])\s+\S",
    "ellipsis": r"(?:\.\.\.|…)\s*$",
    "quoted": r"^\s*(?:>+|[–—])\s*\S",
    "closed": r"[.!?…。！？:][\"”“»'’)\]\s]*$",
    "leader": r"(?:\.{3,}|…{2,}|_{3,}|-{4,})\s*[\p{N}$€]+\s*$",
    "field": r"^\s*[\p{L}_][\p{L}\p{N}_ \-]{0,24}[:=]\s?\S{0,30}(?:\s\S+){0,2}\s*$",
    "rule": r"^[\s\-=_*~#+|.:<>/\\]{3,}$",
    "log": r"^\s*\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d|^\s*\[?\d\d:\d\d:\d\d|\b(?:DEBUG|INFO|WARN|ERROR)\b.*\w=\w",
    "long": r"(?:^|\s)[A-Za-z0-9+/=_\-\\$%&#@^*~!?<>{}\[\]|;:.,'\"()]{40,}(?:\s|$)",
    "hex": r"(?:0x[0-9a-fA-F]{2,}\s.*){2,}",
}


def _lines(texts: list[str]) -> tuple[np.ndarray, pa.Array]:
    """(document number, text) of every line; line ends of any kind."""
    at, out = [], []
    for k, t in enumerate(texts):
        own = re.split(r"\r\n|[\n\r\u2028\u2029\x0b\x0c\x85]", t)
        at += [k] * len(own)
        out += own
    return np.asarray(at, np.int64), pa.array(out, pa.string())


def _repeated(text: str) -> tuple[int, float, int]:
    """(words, share of distinct words, common words) of a text, words in lower case."""
    w = _WORDS.findall(text.lower())
    return len(w), len(set(w)) / max(1, len(w)), sum(map(COMMON.__contains__, w))


def line_statistics(texts: list[str]) -> tuple[pd.DataFrame, dict[int, tuple[int, float, int]]]:
    """(a row for each line: its document, length, counts, flags and form; the word statistics of the longer lines).

    The form is prose, list, table, junk or blank.
    """
    doc, text = _lines(texts)
    s = pd.DataFrame({"doc": doc, "n": pc.utf8_length(text).to_numpy(zero_copy_only=False)})
    bare = pc.replace_substring_regex(text, r"\p{L}+", "")
    s["letters"] = s.n - pc.utf8_length(bare).to_numpy(zero_copy_only=False)
    for c, p in _COUNTS.items():
        s[c] = pc.count_substring_regex(text, p).to_numpy(zero_copy_only=False).astype(np.int64)
    for c, p in _FLAGS.items():
        s[c] = pc.match_substring_regex(text, p).to_numpy(zero_copy_only=False)
    raw = text.to_pylist()
    solid = s.n - s.spaces
    blank = solid <= 0
    letters = s.letters / np.maximum(1, solid)
    cjk = s.cjk > 0.3 * np.maximum(1, s.letters)
    short = np.where(cjk, s.n <= 24, (s.n <= 48) & (s.words <= 8))
    # tables: cells between bars, tabs, semicolons, tight commas or gaps; leaders to a number; frames
    cells = (s.bars >= 2) | ((s.tabs >= 1) & (s.words <= 5 * (s.tabs + 1)) & (s.ends <= s.tabs // 3)) | ((s.semis >= 2) & (s.words <= 3 * (s.semis + 1))) | ((s.gaps >= 2) & (s.words <= 4 * (s.gaps + 1)) & (s.ends <= s.gaps // 2))
    cells |= (s.tight >= 2) & (s.words <= 2.5 * (s.commas + 1)) & (s.ends <= 1)
    table = (cells | s.leader | (s.rule & ((s.bars > 0) | _has(raw, "+-")))) & ~blank
    # lists: bullets, and runs of short open lines; a row of short pieces between commas
    open_ = short & ~s.closed & ~blank
    pieces = (s.commas >= 5) & (s.words <= 5.2 * (s.commas + 1)) & (s.ends <= 1 + s.commas // 12) & ~cjk
    pieces |= cjk & (s.commas >= 5) & (s.n <= 12 * (s.commas + 1)) & (s.ends <= 1)
    # junk: few letters, codes, links, logs, hashtags, menu bars, noise
    junk = (letters < 0.55) & (solid >= 12) | s.rule | s.log | s.hex | (s.long & ~cjk & (s.links == 0) & (s.words <= np.maximum(2, s.n / 24)))
    junk |= (s.links >= 1) & (s.words <= 2 * s.links + 1) | (s.tags >= 3) & (s.tags >= 0.6 * s.words) | (s.dots >= 3) & (s.words <= 5 * (s.dots + 1))
    noise = (solid >= 24) & ~cjk & (s.wordlike < 0.25 * s.words) & (s.words >= 6) & (letters < 0.8)
    junk |= noise
    junk &= ~blank
    again = np.zeros(len(s), bool)
    ends, wide = s.ends.to_numpy(), cjk.to_numpy()
    told: dict[int, tuple[int, float, int]] = {}
    for i in np.nonzero(((s.words >= 12) & ~blank).to_numpy())[0].tolist():
        n, distinct, common = told[i] = _repeated(raw[i])
        # a few words over and over; many words, none of which holds sentences together (where words are written apart)
        again[i] = n >= 12 and distinct <= 0.12 if wide[i] else n >= 12 and ((distinct <= 0.2 and n >= 30) or distinct <= 0.12 or (distinct < 0.5 and common < 0.06 * n and n >= 16) or (common < 0.02 * n and n >= 40 and ends[i] <= n / 60 and _ascii(raw[i])))
    junk |= again
    form = np.select([blank, junk & ~table, table, s.bullet.to_numpy(bool) | (s.quoted & open_).to_numpy(bool), pieces], ["blank", "junk", "table", "list", "list"], "prose").astype(object)
    # runs of short open lines: three or more, blank lines between them allowed
    run = (form == "prose") & open_.to_numpy(bool)
    field = run & s.field.to_numpy(bool)
    d = s.doc.to_numpy()
    i = 0
    at = np.nonzero(form != "blank")[0]
    while i < len(at):
        j = i
        while j < len(at) and d[at[j]] == d[at[i]] and (run[at[j]] or (form[at[j]] == "list" and j > i)):
            j += 1
        if j - i >= 3 and run[at[i]]:
            own = at[i:j]
            own = own[form[own] == "prose"]
            seen = len({raw[x].strip().lower() for x in own}) if len(own) else 0
            kind = "table" if field[own].mean() > 0.6 else "junk" if len(own) >= 6 and seen <= 0.5 * len(own) else "list"
            form[own] = kind
        i = max(j, i + 1)
    s["form"] = form
    return s, told


def _has(raw: list[str], mark: str) -> np.ndarray:
    return np.fromiter((mark in x for x in raw), bool, len(raw))


def _ascii(text: str) -> bool:
    return sum(c.isascii() for c in text) > 0.9 * len(text)


def document_statistics(texts: list[str | None]) -> pd.DataFrame:
    """A row for each text: the statistics, the failed rules, the shares of each form, and whether it is natural prose.

    Null, empty and blank texts have zero counts, no failures and count as no case (natural is true).
    """
    held = [t or "" for t in texts]
    s, told = line_statistics(held or [""])
    g = s.groupby("doc")
    out = pd.DataFrame(index=range(len(held)))
    for c in ("letters", "digits", "spaces", "marks", "words", "links"):
        out[c] = g[c].sum()
    out["chars"] = np.fromiter((len(t) for t in held), np.int64, len(held))
    filled = s[s.form != "blank"]
    fg = filled.groupby("doc")
    size = fg.n.sum().reindex(out.index, fill_value=0)
    out["lines"] = fg.size().reindex(out.index, fill_value=0)
    part = lambda col: fg[col].mean().reindex(out.index).fillna(0.0).astype(float)
    out["bullet_lines"], out["closed_lines"], out["ellipsis_lines"] = part("bullet"), part("closed"), part("ellipsis")
    for f in ("list", "table", "junk"):
        out[f"{f}_share"] = (filled[filled.form == f].groupby("doc").n.sum().reindex(out.index, fill_value=0) / np.maximum(1, size)).astype(float)
    n = np.maximum(1, out.words)
    out["mean_word"] = ((g.n.sum() - out.spaces) / n).astype(float)
    out["symbol_ratio"] = (g.symbols.sum() / n).astype(float)
    out["alphabetic_words"] = (g.lettered.sum() / n).astype(float)
    # a text of one line has been read already
    first = np.nonzero(np.r_[True, s.doc.to_numpy()[1:] != s.doc.to_numpy()[:-1]])[0]
    single = np.diff(np.r_[first, len(s)]) == 1
    own = [told.get(int(i)) or _repeated(t) if alone else _repeated(t) for t, i, alone in zip(held, first, single, strict=True)]
    out["distinct_words"] = [x[1] if x[0] else 0.0 for x in own]
    out["common_words"] = np.asarray([x[2] for x in own], np.int64)
    out["not_prose"] = (out.list_share + out.table_share + out.junk_share).clip(upper=1.0)
    lim = LIMITS
    long_ = (out.words >= lim["least_words"]) & (g.cjk.sum() <= lim["cjk"] * np.maximum(1, out.letters))
    rules = {
        "mean_word": long_ & ((out.mean_word < lim["mean_word_low"]) | (out.mean_word > lim["mean_word_high"])),
        "symbols": long_ & (out.symbol_ratio > lim["symbol_ratio"]),
        "bullets": out.bullet_lines > lim["bullet_lines"],
        "ellipses": out.ellipsis_lines > lim["ellipsis_lines"],
        "alphabetic": long_ & (out.alphabetic_words < lim["alphabetic_words"]),
        "common_words": long_ & (out.common_words < lim["common_words"]),
        "list": out.list_share > lim["not_prose"],
        "table": out.table_share > lim["not_prose"],
        "junk": out.junk_share > lim["not_prose"],
        "not_prose": out.not_prose > lim["not_prose"],
    }
    table = pd.DataFrame(rules)
    out["failures"] = [[r for r, bad in zip(rules, row, strict=True) if bad] for row in table.to_numpy(bool)]
    out["natural"] = ~table[list(DECIDING)].any(axis=1)
    return out


FIELDS = "chars long, words long, letters long, digits long, lines long, mean_word double, symbol_ratio double, alphabetic_words double, closed_lines double, bullet_lines double, ellipsis_lines double, common_words long, distinct_words double, list_share double, table_share double, junk_share double, not_prose double, failures array<string>, natural boolean"
_NAMES = [x.split()[0] for x in FIELDS.split(", ")]


def quality(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and the statistics of FIELDS for every row.

    failures has the name of every rule that a text fails: a published one (word length, symbols, bullets, ellipses, alphabetic
    and common words) or one on the share of the characters (of lines that aren't blank) that lists, tables, junk or all of them
    take.  natural is false if a rule of DECIDING failed.
    Null, empty and blank texts: zeros, no failures, natural.  Rows stay as they are, repeated or null keys too; other columns
    are dropped.  Texts are read whole, a batch at a time; no shuffle.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 2000):
                own = pdf.iloc[lo : lo + 2000]
                got = document_statistics([t if isinstance(t, str) else None for t in own["_text"]])[_NAMES]
                got.insert(0, key, own[key].to_numpy())
                yield got

    return spread(docs.select(key, F.col(text).alias("_text"))).mapInPandas(run, f"`{key}` {kind}, {FIELDS}")
