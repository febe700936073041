"""Splitting oversized texts at natural boundaries, in one projection without shuffle.

Method: one bounded-quantifier regular expression cuts the text; its alternatives are ordered by the strength of the
boundary (end of text, blank line, line, sentence, clause, blank), each taking as much as the limit allows, and fall
back to single characters. Lookback into the preceding cut supplies the overlap, again from a natural start where
there is one: the strongest that leaves a third of the overlap, else the longest ending there is. Offsets and pieces are
built with SQL array functions, in time proportional to the text; only the pieces are exploded.

Lengths are code points. A row at or under the limit is one piece; null and empty texts give no piece. A cut never
falls between CR and LF or before a combining mark, unless a single run is longer than the limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The project's chunk size and overlap.
CHUNK_SIZE = 600
CHUNK_OVERLAP = 150
#: Lengths are added up by runs of so many cuts, so that the time grows with the text and not with its square.
RUN = 64

_CLOSE = "[”’」』）)\"]"
_ENDS = ["(?<=\\n\\r?\\n)(?![\\r\\n])", "(?<=\\n)", f"(?<=[。！？!?；;]{_CLOSE}{{0,2}})(?!{_CLOSE})", f"(?<=[.!?]{_CLOSE}{{0,2}})(?=\\s)", "(?<=[，,、：:])", "(?<=\\s)(?<!\\r)"]
_WHOLE = "(?!\\n)(?![\\p{M}\\x{200d}\\x{fe00}-\\x{fe0f}])"


def cut_pattern(limit: int, overlap: int) -> str:
    """Cuts of at most limit - overlap characters, the first of at most limit."""
    room, strong = limit - overlap, max(1, (limit - overlap) // 3)

    def of(start: str, most: int) -> list[str]:
        good = [f"{start}.{{{min(strong, most)},{most}}}{e}" for e in _ENDS]
        any_size = [f"{start}.{{1,{most}}}{e}" for e in _ENDS]
        return [*good, *any_size, f"{start}.{{1,{most}}}{_WHOLE}", f"{start}.{{1,{most}}}"]

    return "(?s)" + "|".join([f".{{1,{room}}}\\z", *of("\\A", limit), *of("", room)])


def split_texts(df: DataFrame, text: str = "text", limit: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """All columns of df but the text, with piece_no from 1, piece_start (0-based), overlap_chars and piece_text."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    for c in ("piece_no", "piece_start", "overlap_chars", "piece_text", "_t", "_cuts", "_tails", "_sizes", "_runs", "_p"):
        if c in df.columns:
            df = df.withColumnRenamed(c, f"input_{c}")
    t = F.col("_t")
    cuts = F.when(F.length(t) > limit, F.regexp_extract_all(t, F.lit(cut_pattern(limit, overlap)), F.lit(0))).otherwise(F.array(t))
    enough = max(1, overlap // 3)

    def tail(cut):
        """The natural ending of a cut within the overlap: by strength if long enough, else the longest, else characters."""
        if overlap == 0:
            return F.lit("")
        last = F.right(cut, F.lit(overlap + 1))  # and the character before
        end = lambda s, least: F.regexp_extract(last, f"(?s)(?<={s})(?!\\n)(.{{{least},{overlap}}})\\z", 1)
        marks = ("\\n", "[。！？!?；;]", "[，,、：:]", "\\s")
        good = [F.nullif(end(s, enough), F.lit("")) for s in marks]
        return F.coalesce(*good, F.nullif(end("[\\n。！？!?；;，,、：:\\s]", 1), F.lit("")), F.regexp_extract(last, f"(?s)(?<!\\r){_WHOLE}(.{{1,{overlap}}})\\z", 1))

    out = df.withColumnRenamed(text, "_t").where(F.length("_t") > 0).withColumn("_cuts", cuts)
    out = out.withColumn("_tails", F.when(F.size("_cuts") > 1, F.transform("_cuts", tail)).otherwise(F.array(F.lit(""))))
    # Where a cut starts is the sum of the lengths before it: of whole runs of RUN cuts, then of those in its own run.
    add = lambda a, x: a + x
    run = lambda i: F.floor(i / RUN).cast("int")
    total = lambda c, first, n: F.aggregate(F.slice(c, first, n), F.lit(0), add)
    runs = F.transform(F.sequence(F.lit(0), run(F.size("_sizes") - 1)), lambda r: total("_sizes", r * RUN + 1, F.lit(RUN)))
    out = out.withColumn("_sizes", F.transform("_cuts", F.length)).withColumn("_runs", runs)
    # Every array is named outside the lambda too: one named only inside would be inlined there and made once per piece.
    number = F.least(F.size("_cuts"), F.size("_tails") + 1, F.size("_runs") * RUN)
    piece = F.transform(
        F.sequence(F.lit(1), number),
        lambda i: F.struct(
            i.alias("no"),
            (total("_runs", F.lit(1), run(i - 1)) + total("_sizes", run(i - 1) * RUN + 1, (i - 1) % RUN)).alias("start"),
            F.when(i == 1, F.lit("")).otherwise(F.element_at("_tails", F.greatest(i - 1, F.lit(1)))).alias("tail"),
            F.element_at("_cuts", i).alias("cut"),
        ),
    )
    # No array is empty; a plain explode() would filter for that first, with everything above made a second time.
    out = out.withColumn("_p", piece).drop("_t", "_cuts", "_tails", "_sizes", "_runs").withColumn("_p", F.explode_outer("_p"))
    back = F.length("_p.tail")
    return out.withColumns({"piece_no": F.col("_p.no"), "piece_start": F.col("_p.start") - back, "overlap_chars": back, "piece_text": F.concat("_p.tail", "_p.cut")}).drop("_p")
