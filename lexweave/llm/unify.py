"""Visually identical text in one ordinary form.

Method: compatibility normalisation in composed form of every letter, digit and radical, mapped whitespace, removal of
default-ignorable characters, look-alike letters resolved by the script of their word, and (for the comparison key)
full case folding; run once per distinct value of a batch, and only on values that hold anything but plainly
ordinary characters (tested JVM-side).

Kept as they are, against compatibility normalisation: punctuation of any width, unit signs, circled and raised numbers
(all that is neither letter nor digit, and numbers of the category No), letters up to U+024F, one U+3000 after an
article label, words wholly in their own script. Letter-like signs and Greek symbol letters stand for a letter inside
a word only. Null stays null, an empty value stays empty.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Code point ranges of the Unicode standard.
IGNORABLE = [(0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF)]
SPACES = [(0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x202F, 0x202F), (0x205F, 0x205F)]
BREAKS = [(0x85, 0x85), (0x2028, 0x2029)]
#: Never in need of a look: ASCII, Latin letters, ideographs, kana but katakana, punctuation, numbered and unit signs, drawings.
PLAINLY = [(0x0, 0x7F), (0xA1, 0xAC), (0xAE, 0x24F), (0x2012, 0x2027), (0x2030, 0x205E), (0x2070, 0x20CF), (0x2103, 0x2103), (0x2109, 0x2109), (0x2190, 0x2211), (0x2213, 0x25CA), (0x25CC, 0x25EE), (0x25F0, 0x27BF), (0x3001, 0x3037), (0x303B, 0x309E), (0x30FB, 0x30FB), (0x3200, 0x4DBF), (0x4E00, 0x9FFF), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF64), (0xFFE0, 0xFFE6), (0x20000, 0x2F7FF), (0x30000, 0x323AF)]
#: Compatibility letters that are ordinary in their own script: Thai to Tibetan vowels, jamo, digraphs of kana.
OWN = [(0xE00, 0xFFF), (0x3130, 0x318F), (0x309F, 0x309F), (0x30FF, 0x30FF), (0xFFA1, 0xFFDC)]
#: Letter-like signs, modifier letters and symbol forms of Greek letters: a letter only inside a word.
SIGNS = [(0x2B0, 0x2FF), (0x3D0, 0x3F6), (0x1D2C, 0x1DBF), (0x2100, 0x214F)]
HYPHENS = [(0x2010, 0x2011), (0x2212, 0x2212)]
# Radicals without a compatibility mapping and the simplified ideograph each stands for.
RADICALS = dict(zip("⺟⺠⻁⻄⻅⻆⻉⻋⻓⻔⻘⻙⻚⻛⻜⻝⻢⻣⻤⻥⻦⻩⻬⻮⻰⻳", "母民虎西见角贝车长门青韦页风飞食马骨鬼鱼鸟黄齐齿龙龟"))
# Cyrillic and Greek letters that look like a Latin letter.
LOOKS = dict(zip("АВЕЅІЈКМНОРСТУХаеорсухѕіјһԁԛԝӀΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABESIJKMHOPCTYXaeopcyxsijhdqwIABEZHIKMNOPTYXo"))
# Letters that look like a Latin letter inside a word that also has Latin ones; alone they are their own.
LOOKS_MIXED = LOOKS | dict(zip("ανιρυκвкмнтӏүҮ", "avipukbkmhtlyY"))
LOOKS_MIXED |= dict(zip("օսոհցզյՕՍԼՏ", "ounhgqjOULS"))
LOOKS_MIXED |= dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ"))
LOOKS_MIXED |= dict(zip("ɑɡɩʏꓐꓑꓒꓓꓔꓖꓗꓙꓚꓜꓝꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "agiYBPdDTGKJCZFNLSRVHWXYAEIOU"))
#: The other way round, for a Cyrillic word with a few Latin letters in it.
LATIN_TO_CYRILLIC = {v: k for k, v in reversed(LOOKS.items()) if "\u0400" <= k <= "\u04ff"}
# Katakana that look like an ideograph.
KANA_LOOKS = dict(zip("エカニハロータトチミヒ", "工力二八口一夕卜千三匕"))


def _expand(ranges: list[tuple[int, int]]) -> list[int]:
    return [c for a, b in ranges for c in range(a, b + 1)]


def _py(ranges: list[tuple[int, int]]) -> str:
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


def _java(ranges: list[tuple[int, int]]) -> str:
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)


SUSPECT_JAVA = f"[^{_java(PLAINLY)}\\x{{3000}}]|(?<!条)\\x{{3000}}"
SUSPECT = re.compile(f"[^{_py(PLAINLY)}\u3000]|(?<!条)\u3000")


def _compatible(c: int) -> str | None:
    """What a letter, digit or radical is under compatibility composition, if that is something else."""
    ch = chr(c)
    kind = unicodedata.category(ch)
    if kind[0] != "L" and kind not in ("Nd", "Nl") and not (0x2E80 <= c <= 0x2FD5 or 0x3038 <= c <= 0x303A):
        return None
    n = unicodedata.normalize("NFKC", ch)
    return n if n != ch and unicodedata.normalize("NFC", ch) != n or 0xF900 <= c <= 0xFAFF or 0x2F800 <= c <= 0x2FA1F else None


_KEPT = set(_expand(OWN))
_LETTERS = {c: n for c in [*range(0x250, 0x3400), *range(0xA640, 0xAC00), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1EE00, 0x1EF00), *range(0x2F800, 0x2FA20)] if c not in _KEPT and (n := _compatible(c))}
_SIGNS = {chr(c): n for c in _expand(SIGNS) if (n := _LETTERS.pop(c, None) or _compatible(c) or (c in (0x212A, 0x212B) and unicodedata.normalize("NFC", chr(c))))}
_CHARS: dict[int, str | None] = dict.fromkeys(_expand(IGNORABLE)) | _LETTERS
_CHARS |= {ord(k): v for k, v in RADICALS.items()} | dict.fromkeys(_expand(BREAKS), "\n")
_SIGN = "[" + re.escape("".join(_SIGNS)) + "]"
_IN_WORD = re.compile(f"(?<=[A-Za-z]){_SIGN}+|{_SIGN}+(?=[A-Za-z])")

_SPACE = "[" + _py(SPACES) + "]"
_LABEL_SPACE = re.compile(rf"(?m)^(第[^\s\u3000]{{1,16}}条){_SPACE}")
_ANY_SPACE = re.compile(_SPACE)
_LABEL_WIDE = re.compile("(?m)^(第[^\\s]{1,16})\u3000")
_STRAY_WIDE = re.compile("(?<!条)\u3000")
_OTHERS = "\u0250-\u02af\u0370-\u03ff\u0400-\u052f\u0531-\u0587\u13a0-\u13ff\ua4d0-\ua4ff"
_WORD = re.compile(f"[A-Za-z\u00c0-\u024f\u0300-\u036f{_OTHERS}]+")
_OTHER = re.compile(f"[{_OTHERS}]")
_LATIN = re.compile("[A-Za-z\u00c0-\u024f]")
_KANA_RUN = re.compile("[\u30a1-\u30fa\u30fc]+")
_NUMERAL = "一二三四五六七八九十百千零〇○◯0-9"
_RING = re.compile(f"(?<=[{_NUMERAL}])[○◯]|[○◯](?=[{_NUMERAL}])")
_HYPHEN = re.compile("(?<=[A-Za-z0-9])[\u2010\u2011\u2212](?=[A-Za-z0-9])")
_HAN = re.compile("[\u3400-\u9fff\U00020000-\U0003ffff]")


def _words(text: str) -> str:
    """Greek and Cyrillic letters that stand for Latin ones, by the script of their word and of its neighbours."""
    found = [(m.start(), m.end(), m.group()) for m in _WORD.finditer(text)]
    kind = []
    for _, _, w in found:
        o, latin = _OTHER.findall(w), _LATIN.search(w)
        spoken = any("\u0250" <= c <= "\u02af" and c not in LOOKS_MIXED for c in o)  # phonetic spelling
        kind.append("latin" if not o else "own" if spoken else "mixed" if latin else "own" if any(c not in LOOKS for c in o) else "fake")
    out, at = [], 0
    for i, (a, b, w) in enumerate(found):
        k = kind[i]
        if k == "fake":
            near = [j for j in (i - 1, i + 1) if 0 <= j < len(found) and not (text[found[min(i, j)][1] : found[max(i, j)][0]]).strip(" -")]
            if any(kind[j] == "own" for j in near):
                k = "own"
                kind[i] = "own"
        if k in ("mixed", "fake"):
            table = LOOKS_MIXED if k == "mixed" else LOOKS
            if k == "mixed" and sum(c not in LOOKS_MIXED for c in _OTHER.findall(w)) > len(_LATIN.findall(w)):
                table = LATIN_TO_CYRILLIC
            out.append(text[at:a] + "".join(table.get(c, c) for c in w))
            at = b
    return "".join(out) + text[at:] if out else text


def _kana(text: str) -> str:
    def one(m: re.Match) -> str:
        run, before, after = m.group(), text[max(0, m.start() - 1) : m.start()], text[m.end() : m.end() + 1]
        if any(c not in KANA_LOOKS for c in run) or any("\u3041" <= c <= "\u309f" for c in before + after):
            return run
        numbered = before in ("（", "(") and after in ("）", ")")  # an item's number in brackets
        if not (numbered or _HAN.match(before) or _HAN.match(after)):
            return run
        return "".join(KANA_LOOKS[c] for c in run)

    return _KANA_RUN.sub(one, text)


def ordinary(text: str) -> str:
    """The ordinary form of one value; a value already ordinary comes back unchanged."""
    if not text or not SUSPECT.search(text):
        return text
    t = text.translate(_CHARS)
    t = _IN_WORD.sub(lambda m: "".join(_SIGNS[c] for c in m.group()), t)
    t = _ANY_SPACE.sub(" ", _LABEL_SPACE.sub("\\1\u3000", t))
    if _STRAY_WIDE.search(t):
        t = _LABEL_WIDE.sub("\\1\ue000", t)
        t = _STRAY_WIDE.sub(" ", t).replace("\ue000", "\u3000")
    t = unicodedata.normalize("NFC", t) if not t.isascii() and _has_mark(t) else t
    if _OTHER.search(t):
        t = _words(t)
        if _has_mark(t):
            t = unicodedata.normalize("NFC", t)
    if _KANA_RUN.search(t):
        t = _kana(t)
    return _HYPHEN.sub("-", _RING.sub("〇", t))


_MARK = re.compile("[\u0300-\u036f\u3099\u309a]")


def _has_mark(t: str) -> bool:
    return _MARK.search(t) is not None


def comparison_key(text: str) -> str:
    """Ordinary form, compatibility-composed, fully case-folded, blanks squeezed: equal for texts that read the same."""
    t = unicodedata.normalize("NFKC", ordinary(text))
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t.casefold())).strip()


def _per_distinct(values: pd.Series, fn) -> pd.Series:
    known = {v: fn(v) for v in values.dropna().unique()}
    return values.map(known).astype(object).where(values.notna(), None)


@F.pandas_udf(T.StringType())
def _ordinary_udf(values: pd.Series) -> pd.Series:
    return _per_distinct(values, ordinary)


@F.pandas_udf(T.StringType())
def _key_udf(values: pd.Series) -> pd.Series:
    return _per_distinct(values, comparison_key)


def ordinary_column(c: Column) -> Column:
    """Only suspicious values travel to Python; the rest pass through JVM-side."""
    return F.coalesce(_ordinary_udf(F.when(c.rlike(SUSPECT_JAVA), c)), c)


def key_column(c: Column) -> Column:
    return _key_udf(c)


def unify(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each named column in its ordinary form; other columns and all rows are kept."""
    return df.withColumns({c: ordinary_column(F.col(f"`{c}`")) for c in columns})


def changed_values(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field_name, stored, ordinary): the values whose ordinary form differs from the stored one."""
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(f"`{c}`").cast("string").alias("stored")) for c in columns])).alias("_f")
    long = df.select(F.col(f"`{key}`").alias(key), fields).select(key, "_f.field_name", "_f.stored").where(F.col("stored").rlike(SUSPECT_JAVA))
    return long.withColumn("ordinary", _ordinary_udf("stored")).where("ordinary <> stored")
