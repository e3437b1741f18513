"""Line dedup: suffixes of line-id sequences ranked by distributed prefix doubling; later copies of repeated runs go."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, drop_cut, free, small_batches

#: Lines that a repeated run has at least.
MIN_LINES = 2
#: Words that a line has at least to be a repeated run on its own; None: no line is.
LONE_WORDS = 1
NO_ID = np.iinfo(np.int64).max

#: A document's place in the order of copies: its id (null: last), then its text's hash; and a line's number in it.
DOC = ("d", "t")
PLACE = (*DOC, "i")
#: The first place of a run.
SOURCE = ("fd", "ft", "fi")

#: Words of the column `line`.
WORDS = "regexp_count(line, '[^\\\\x20\\\\x09-\\\\x0D]+')"


def doc_key(docs: DataFrame) -> list:
    """The columns DOC of docs; rows with equal id and text are one document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.xxhash64(text)]


def ranked(rows: DataFrame, a: str, b: str, *more: str) -> DataFrame:
    """Places of rows(*PLACE, a, b, *more) whose (a, b) occurs at two places or more, with its rank `r`, its first place SOURCE
    and the columns `more`.

    Ranks keep the order of (a, b): pairs, not places, are sorted over range partitions and numbered there, so a pair that
    very many places share is one row. The join back to the places is an equi-join that adaptive execution can split. Rows may
    repeat a place: two places differ in their least and their greatest.
    """
    place = F.struct(*PLACE)
    pairs = rows.groupBy(a, b).agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last")
    order = pairs.repartitionByRange(a, b).sortWithinPartitions(a, b).select(a, b, *(F.col(f"first.{p}").alias(f) for p, f in zip(PLACE, SOURCE, strict=True)), F.monotonically_increasing_id().alias("r"))
    return rows.join(order, [a, b]).select(*PLACE, "r", *SOURCE, *more)


def line_runs(docs: DataFrame) -> DataFrame:
    """Places of single lines that occur more than once, with their `words`, runs of other bytes than ASCII white space: the
    suffixes whose longest common prefix is a line or more. Only two hashes of a line move, the second of the salted line."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = docs.select(*(c.alias(n) for c, n in zip(doc_key(docs), DOC, strict=True)), F.posexplode(F.split(text, "\n")).alias("i", "line"))
    rows = lines.select(*PLACE, F.xxhash64("line").alias("a"), F.xxhash64(F.concat(F.lit("\x01salt"), F.col("line"))).alias("b"), F.expr(WORDS).alias("words"))
    return ranked(rows, "a", "b", "words").dropDuplicates(list(PLACE))


def doubled(runs: DataFrame, by: int) -> DataFrame:
    """From places of repeated runs to those of repeated runs `by` lines longer: the pair of a place's rank and the rank `by`
    lines on ranks the longer run. A longer run is repeated only if both its parts are, so other places drop out."""
    on = runs.select(*DOC, (F.col("i") - by).alias("i"), F.col("r").alias("b"))
    return ranked(runs.select(*PLACE, F.col("r").alias("a")).join(on, list(PLACE)), "a", "b")


class Suffixes:
    """The suffix array of all documents' lines, as ranks of the runs of 1, 2, 4, ... lines that begin at each place.

    Prefix doubling goes on until no run is repeated. Places of one rank at a level are an interval of the suffix array whose
    longest common prefix is that level's lines or more; a place that drops out at a level is alone from there on. Each level
    is a written table, smaller than the last.
    """

    def __init__(self, docs: DataFrame) -> None:
        self.levels = [cut(line_runs(docs), "runs")]
        while not self.levels[-1].isEmpty():
            self.levels.append(cut(doubled(self.levels[-1], 1 << (len(self.levels) - 1)), "runs"))
        if len(self.levels) > 1:
            drop_cut(self.levels.pop())

    def runs(self, lines: int) -> DataFrame:
        """Places of repeated runs of `lines` lines, with rank and first place. For a length between two powers, two runs of
        the power below overlap."""
        k = min(lines.bit_length() - 1, len(self.levels) - 1)
        if lines == 1 << k:
            return self.levels[k].select(*PLACE, "r", *SOURCE)
        if lines > 2 << k:
            return self.levels[0].select(*PLACE, "r", *SOURCE).filter("false")
        return doubled(self.levels[k], lines - (1 << k))

    def shared(self, pairs: DataFrame) -> DataFrame:
        """pairs (*PLACE, *SOURCE) with `lines`, the longest common prefix of their suffixes: from the longest level down, equal
        ranks at both ends of what is known to be shared lengthen it by the level's lines."""
        now = pairs.withColumn("lines", F.lit(0))
        for k in range(len(self.levels) - 1, -1, -1):
            rank = self.levels[k].select(*PLACE, "r")
            here = rank.select(*(F.col(p).alias(f"p{p}") for p in PLACE), F.col("r").alias("ra"))
            there = rank.select(*(F.col(p).alias(f"q{p}") for p in PLACE), F.col("r").alias("rb"))
            met = now.join(here, (F.col("pd") == F.col("d")) & (F.col("pt") == F.col("t")) & (F.col("pi") == F.col("i") + F.col("lines")), "left")
            met = met.join(there, (F.col("qd") == F.col("fd")) & (F.col("qt") == F.col("ft")) & (F.col("qi") == F.col("fi") + F.col("lines")), "left")
            now = met.withColumn("lines", F.col("lines") + F.when(F.col("ra") == F.col("rb"), 1 << k).otherwise(0)).select(*PLACE, *SOURCE, "lines")
        return now

    def copied_runs(self, min_lines: int = MIN_LINES) -> DataFrame:
        """Maximal copied runs: places (*PLACE) where a later copy of a run of min_lines or more begins, its source (*SOURCE)
        and its `lines`.

        A later place's source is the first place of the run of min_lines there. Where the place before copies the place before
        the source, the run began earlier; else it begins here and goes on as long as the suffixes agree. Every later copy of a
        run of min_lines lies in one of these.
        """
        later = cut(self.runs(min_lines).filter(F.struct(*SOURCE) < F.struct(*PLACE)).select(*PLACE, *SOURCE), "later")
        after = later.select(*DOC, (F.col("i") + 1).alias("i"), "fd", "ft", (F.col("fi") + 1).alias("fi"))
        return self.shared(later.join(after, [*PLACE, *SOURCE], "left_anti"))

    def drop(self) -> None:
        for level in self.levels:
            drop_cut(level)


def longest_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, and the lines of the longest run in it that is a later copy, for documents with one."""
    runs = Suffixes(docs).copied_runs(1)
    return runs.groupBy("d").agg(F.max("lines").cast("long").alias("lines")).select(F.when(F.col("d") != NO_ID, F.col("d")).alias("doc_id"), "lines")


def later_copies(docs: DataFrame, min_lines: int = MIN_LINES, lone_words: int | None = None) -> DataFrame:
    """Per document (d, t) with some, `gone`: begin and lines of each maximal copied run, and of each lone later line."""
    suffixes = Suffixes(docs)
    runs = suffixes.copied_runs(min_lines).select(*DOC, F.struct("i", "lines").alias("run"))
    if lone_words is not None:
        lone = suffixes.levels[0].filter((F.struct(*SOURCE) < F.struct(*PLACE)) & (F.col("words") >= lone_words))
        runs = runs.union(lone.select(*DOC, F.struct("i", F.lit(1).alias("lines")).alias("run")))
    out = cut(runs.groupBy(*DOC).agg(F.collect_list("run").alias("gone")), "copied-runs")
    suffixes.drop()
    return out


#: The columns that without_copies appends.
KEPT = ("kept_text", "kept_lines", "gone_lines")


def without_copies(docs: DataFrame, min_lines: int = MIN_LINES, lone_words: int | None = None, names: tuple[str, ...] = KEPT) -> DataFrame:
    """docs with kept_text (the lines that stay, joined by newlines), kept_lines and gone_lines, or these columns by the given
    names, which docs must not have.

    A run is min_lines or more consecutive lines of one document, compared whole and unchanged, and with lone_words also one
    line of so many words or more. Of a repeated run, the copy at the smallest (doc_id, line) stays; every line inside a later
    copy goes, also where copies overlap. Null text is as empty, which is one empty line; a null doc_id comes last; rows with
    equal id and text are one document and have one result; columns of any name are carried along; an empty table gives no
    rows. Lines are equal by 128 bits of two hashes.
    """
    small_batches(docs.sparkSession)
    d, t, gone = free([*docs.columns, *names], "d", "t", "gone")
    later = later_copies(docs, min_lines, lone_words).select(F.col("d").alias(d), F.col("t").alias(t), F.col("gone").alias(gone))
    both = docs.withColumns(dict(zip((d, t), doc_key(docs), strict=True))).join(later, [d, t], "left").drop(d, t)
    kinds = (T.StringType(), T.LongType(), T.LongType())
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds, strict=True))])
    kept = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, removed = [], [], []
            for text, out in zip(batch["text"], batch[gone], strict=True):
                lines = (text.as_py() or "").split("\n")
                if out.is_valid:
                    stay = np.zeros(len(lines) + 1, np.int64)
                    begin, size = (out.values.field(c).to_numpy() for c in ("i", "lines"))
                    np.add.at(stay, begin, 1)
                    np.add.at(stay, begin + size, -1)
                    left = [lines[k] for k in np.flatnonzero(np.cumsum(stay[:-1]) == 0).tolist()]
                else:
                    left = lines
                texts.append("\n".join(left))
                counts.append(len(left))
                removed.append(len(lines) - len(left))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], names=[*kept, *names])

    return both.select(*kept, gone).mapInArrow(run, schema)


def drop_repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, lone_words: int | None = None) -> DataFrame:
    """The columns of docs with later copies of runs deleted from text, and n_chars, if there, to match. Documents of which
    nothing is left are dropped; those that were empty before stay."""
    text, left, gone = free(docs.columns, *KEPT)
    out = without_copies(docs, min_lines, lone_words, (text, left, gone)).filter(F.col(left) > 0).withColumn("text", F.when(F.col(gone) > 0, F.col(text)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


#: The same deletion for the columns that the query returns, in DuckDB's SQL, for unique ids: runs of two lines, chains of which
#: cover every longer run, and single lines with a word.
ORACLE_SQL = r"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents),
w as (select doc_id, i, line, lead(line) over (partition by doc_id order by i) as after, row_number() over (partition by line order by doc_id, i) as lone from l),
f as (select *, row_number() over (partition by line, after order by doc_id, i) as copy from w where after is not null),
g as (select doc_id, i from f where copy > 1 union select doc_id, i + 1 from f where copy > 1 union select doc_id, i from w where lone > 1 and regexp_matches(line, '[^\x20\x09-\x0D]'))
select l.doc_id, cast(count(*) as bigint) as n_lines, cast(count(g.i) as bigint) as n_removed,
  sha256(coalesce(string_agg(l.line, chr(10) order by l.i) filter (where g.i is null), '')) as kept_sha256
from l left join g on l.doc_id = g.doc_id and l.i = g.i group by l.doc_id
"""
