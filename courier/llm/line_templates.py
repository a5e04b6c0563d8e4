"""Line dedup by a log-template tree, with DataFrame functions only.

Lines are parsed to a fixed depth: their number of tokens, then their leading tokens, where a token with a digit in it
is a variable field. Lines with equal keys share a leaf. In a leaf whose lines agree in at least `agree` of their
positions the other positions are variable fields too, and all its lines have one template; in any other leaf a line's
template is the line itself with its variable fields masked. A template that occurs in `min_docs` documents or more is
recurring: it stays in the document with the smallest id of those that hold it, and is dropped from all others.

With `grouped` (the pipeline) the lines of a leaf are compared with templates instead: the commonest token of each
place, and lines that agree with it in at least `agree` of the places have this template; so on with the lines left
over. Where the commonest line doesn't agree with the template, it gathers its like in the same round. Lines
with too many tokens that no other line has in their places are by themselves. A leaf that is one template without
`grouped` is one with it. Rounds are jobs as long as many lines are left, and arrays on the driver for the last ones.

So no text vanishes from the corpus altogether, however many copies of it there are. Documents keep their rows, even
if no line is left.

Nulls: a null text has no lines and stays null. Blank lines have no template and stay. Null ids count together as one
document, below all others. Rows with one id are one document for the count, and each is cut by its own lines. Empty
tables give empty results. Other columns pass through `drop_templates` unchanged, whatever their names.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, cut_table

DEPTH = 4
AGREE = 0.7
MIN_DOCS = 3
FIELD = "<*>"
BLANK = " \t\r\x0b\x0c"
NO_ID = -(1 << 63)
#: Numbers (8 bytes each) up to which a table of them is broadcast; above, it is joined by a shuffle. The driver holds
#: a table as it came, as a hash table that grew by doubling, and as it is sent: several times these bytes.
BROADCAST_NUMBERS = 200_000
#: Numbers up to which the lines that are left to be grouped come to the driver, which does all further rounds at once:
#: each round as jobs leaves plans, classes and task records in the driver's memory, however few lines it settles.
DRIVER_NUMBERS = 1_000_000


def keys(id_col: str, text_col: str) -> list[Column]:
    """What a row is known by: its id and its text."""
    return [F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("__id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("__text")]


def same_line(clean: Column) -> Column:
    return F.xxhash64(clean)


def lines_of(docs: DataFrame, id_col: str, text_col: str, depth: int) -> DataFrame:
    """(__id, __text, line, leaf, masked, check, clean) for each line with a token in it; leaf, masked and check are hashes.

    A line that is its own template is known by 96 bits, masked and check, so lines that share a hash aren't one template.
    """
    raw = F.col("raw")
    at = docs.select(*keys(id_col, text_col), F.posexplode(F.split(F.col(f"`{text_col}`").cast("string"), "\n")).alias("line", "raw"))
    # asked of the raw line: a condition on the clean one would be pushed below it and clean each line twice
    at = at.where(F.btrim(raw, F.lit(BLANK)) != "")
    uneven = reduce(Column.__or__, [F.contains(raw, F.lit(c)) for c in ("  ", *BLANK[1:])])
    at = at.select("__id", "__text", "line", F.trim(F.when(uneven, F.regexp_replace(raw, f"[{BLANK}]+", " ")).otherwise(raw)).alias("clean"))
    at = at.withColumn("clean", F.when(F.col("clean").rlike("[0-9]"), F.regexp_replace("clean", "(?<![^ ])[^ 0-9]*+[0-9][^ ]*", FIELD)).otherwise(F.col("clean")))
    n = F.octet_length("clean") - F.octet_length(F.replace(F.col("clean"), F.lit(" "))) + 1
    return at.select("__id", "__text", "line", F.xxhash64(n, F.substring_index("clean", " ", depth)).alias("leaf"), same_line(F.col("clean")).alias("masked"), F.hash("clean").alias("check"), "clean")


def bounded(df: DataFrame, numbers: Column | None = None) -> DataFrame:
    """A materialised table, to be broadcast if it is small: `numbers` are those that a row holds, one for each column if not given."""
    held = df.agg(F.coalesce(F.sum(F.lit(len(df.columns)) if numbers is None else numbers), F.lit(0)).cast("long")).first()[0]
    return F.broadcast(df) if held <= BROADCAST_NUMBERS else df


def agreeing(tokens: Column, template: Column) -> Column:
    """In how many places two lines of a leaf have the same token."""
    return F.aggregate(F.zip_with(tokens, template, lambda a, b: (a == b).cast("int")), F.lit(0), lambda n, x: n + x)


def hashed(leaf: int, kind: int | None = None) -> int:
    """xxhash64() of the leaf, or of the leaf and the kind, as Spark has it."""
    h = xxhash.xxh64_intdigest(struct.pack("<q", leaf), 42)
    if kind is not None:
        h = xxhash.xxh64_intdigest(struct.pack("<i", kind), h)
    return h - (1 << 64) if h >> 63 else h


def leaf_groups(leaf: int, masked: np.ndarray, many: np.ndarray, tokens: np.ndarray, agree: float, min_docs: int) -> list[tuple[int, int]]:
    """The rounds of groups() for the lines of one leaf, a row of tokens for each: (masked, template) of those that share one."""
    out, size = [], tokens.shape[1]
    while len(masked) and many.sum() >= min_docs:
        top, own = np.empty(size, np.int64), np.zeros(len(masked), np.int64)
        for place in range(size):
            values, at, n = np.unique(tokens[:, place], return_inverse=True, return_counts=True)
            sums = np.bincount(at, many, len(values))
            top[place] = values[np.flatnonzero(sums == sums.max())[-1]]
            own += n[at] == 1
        most = tokens[np.lexsort((masked, many))[-1]]
        like = (tokens == top).sum(axis=1) >= agree * size
        kind = np.where(like, 0, -1)
        if (most == top).sum() < agree * size:
            kind[~like & ((tokens == most).sum(axis=1) >= agree * size)] = 1
        name = [hashed(leaf, 0), hashed(leaf, 1)]
        out += [(m, name[k]) for m, k in zip(masked.tolist(), kind.tolist()) if k >= 0]
        rest = (kind < 0) & (size - own >= agree * size)
        leaf, masked, many, tokens = hashed(leaf), masked[rest], many[rest], tokens[rest]
    return out


def groups(lines: DataFrame, agree: float, min_docs: int) -> DataFrame:
    """(masked, template) for the lines (leaf, masked, many, tokens; each masked once) that share a template with others.

    Each round takes the commonest line of each leaf at least, so that all lines are settled in the end.
    """
    left, taken = cut_table(lines), []  # as files: the constraints that a checkpoint inherits would double with each round
    while held := left.agg(F.sum(F.size("tokens") + 3)).first()[0]:
        if held <= DRIVER_NUMBERS:
            few, of = left.toArrow(), defaultdict(list)
            masked, many = few["masked"].to_numpy(), few["many"].to_numpy()
            ends = np.append(0, np.cumsum(pc.list_value_length(few["tokens"]).to_numpy()))
            for i, key in enumerate(zip(few["leaf"].to_pylist(), np.diff(ends).tolist())):
                of[key].append(i)
            tokens = pc.list_flatten(few["tokens"]).to_numpy()
            found = [x for (leaf, _), at in of.items() for x in leaf_groups(leaf, masked[at], many[at], np.stack([tokens[ends[i] : ends[i + 1]] for i in at]), agree, min_docs)]
            columns = np.array(found, np.int64).reshape(-1, 2)
            taken.append(left.sparkSession.createDataFrame(pa.table({"masked": columns[:, 0], "template": columns[:, 1]})))
            break
        tokens = left.select("leaf", "masked", "many", F.posexplode("tokens").alias("place", "token"))
        counts = cut(tokens.groupBy("leaf", "place", "token").agg(F.sum("many").alias("many"), F.count("*").alias("n"), F.min("masked").alias("masked")))
        top = counts.groupBy("leaf", "place").agg(F.max(F.struct("many", "token")).alias("top")).groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("place", "top.token"))).alias("top")).select("leaf", F.col("top.token").alias("top"))
        most = left.groupBy("leaf").agg(F.max(F.struct("many", "masked", "tokens")).alias("most"), F.sum("many").alias("all")).where(F.col("all") >= min_docs).select("leaf", F.col("most.tokens").alias("most"))
        enough = lambda a, b: agreeing(F.col(a), F.col(b)) >= agree * F.size(a)
        templates = cut(top.join(most, "leaf").select("leaf", "top", F.when(~enough("most", "top"), F.col("most")).alias("most")))
        # tokens that only one line has in their place
        own = counts.where("n = 1").groupBy("masked").agg(F.count("*").alias("own"))
        kind = F.when(enough("tokens", "top"), 0).when(enough("tokens", "most"), 1)
        held = 1 + F.size("top") + F.coalesce(F.size("most"), F.lit(0))
        seen = cut(left.join(bounded(templates, held), "leaf").withColumn("kind", kind))
        taken.append(seen.where("kind is not null").select("masked", F.xxhash64("leaf", "kind").alias("template")))
        rest = seen.where("kind is null").join(own, "masked", "left")
        left = cut_table(rest.where(F.size("tokens") - F.coalesce("own", F.lit(0)) >= agree * F.size("tokens")).select(F.xxhash64("leaf").alias("leaf"), "masked", "many", "tokens"))
    out = reduce(DataFrame.unionAll, taken) if taken else lines.select("masked", F.col("leaf").alias("template"))
    return cut(out.join(out.groupBy("template").agg(F.count("*").alias("n")).where("n > 1"), "template").select("masked", "template"))


def grouped_lines(docs: DataFrame, id_col: str, text_col: str, depth: int = DEPTH, agree: float = AGREE, min_docs: int = MIN_DOCS) -> DataFrame:
    """As template_lines(), with as many templates in a leaf as it has groups of lines."""
    lines = cut(lines_of(docs, id_col, text_col, depth).drop("clean"))
    wide = lines.groupBy("leaf").agg(F.min("masked").alias("a"), F.max("masked").alias("b"), F.countDistinct("__id").alias("docs"))
    mixed = cut(wide.where((F.col("a") != F.col("b")) & (F.col("docs") >= min_docs)).select("leaf"))
    again = lines_of(docs, id_col, text_col, depth).select("leaf", "masked", "clean").join(bounded(mixed), "leaf")
    once = again.groupBy("leaf", "masked").agg(F.count("*").alias("many"), F.first("clean").alias("clean"))
    found = groups(once.select("leaf", "masked", "many", F.transform(F.split("clean", " "), lambda t: F.xxhash64(t)).alias("tokens")), agree, min_docs)
    return lines.join(bounded(found), "masked", "left").select("__id", "__text", "line", F.coalesce("template", "masked").alias("template"), F.when(F.col("template").isNull(), F.col("check")).otherwise(0).alias("check"))


def template_lines(docs: DataFrame, id_col: str, text_col: str, depth: int = DEPTH, agree: float = AGREE, min_docs: int = MIN_DOCS) -> DataFrame:
    """(__id, __text, line, template, check) for each line with a token in it."""
    lines = cut(lines_of(docs, id_col, text_col, depth).drop("clean"))
    wide = lines.groupBy("leaf").agg(F.min("masked").alias("a"), F.max("masked").alias("b"), F.countDistinct("__id").alias("docs"))
    mixed = cut(wide.where((F.col("a") != F.col("b")) & (F.col("docs") >= min_docs)).select("leaf"))
    again = lines_of(docs, id_col, text_col, depth).select("leaf", "clean").join(bounded(mixed), "leaf")
    tokens = again.select("leaf", F.posexplode(F.split("clean", " ")).alias("place", "token")).select("leaf", "place", F.xxhash64("token").alias("h"))
    places = tokens.groupBy("leaf", "place").agg((F.min("h") == F.max("h")).alias("fixed"))
    # one template for the leaf if enough of its positions are the same in all its lines
    merged = cut(places.groupBy("leaf").agg(F.count_if("fixed").alias("fixed"), F.count("*").alias("n")).where(F.col("fixed") >= agree * F.col("n")).select("leaf", F.lit(True).alias("one")))
    return lines.join(bounded(merged), "leaf", "left").select("__id", "__text", "line", F.when(F.col("one"), F.col("leaf")).otherwise(F.col("masked")).alias("template"), F.when(F.col("one").isNull(), F.col("check")).otherwise(0).alias("check"))


def dropped_lines(docs: DataFrame, id_col: str, text_col: str, depth: int = DEPTH, agree: float = AGREE, min_docs: int = MIN_DOCS, grouped: bool = False) -> DataFrame:
    """(__id, __text, n_lines, drop): the lines with tokens of each row, and which of its lines go."""
    lines = cut((grouped_lines if grouped else template_lines)(docs, id_col, text_col, depth, agree, min_docs))
    recurring = lines.groupBy("template", "check").agg(F.countDistinct("__id").alias("docs"), F.min("__id").alias("home")).where(F.col("docs") >= min_docs)
    recurring = cut(recurring.select("template", "check", "home"))
    gone = lines.join(recurring, ["template", "check"]).where("__id <> home").select("__id", "__text", "line").distinct()
    return gone.groupBy("__id", "__text").agg(F.collect_list("line").alias("drop"))


def drop_templates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, agree: float = AGREE, min_docs: int = MIN_DOCS, dropped: str | None = None, grouped: bool = False) -> DataFrame:
    """The documents with the lines of recurring templates cut; optionally a column with the number of lines cut."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    own = dict(zip(docs.columns, names))
    gone = dropped_lines(docs, id_col, text_col, depth, agree, min_docs, grouped)
    joined = plain.select("*", *keys(own[id_col], own[text_col])).join(gone, ["__id", "__text"], "left")
    text = F.col(own[text_col]).cast("string")
    raw = F.split(text, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(raw) - 1), "drop")
    new = F.when(F.col("drop").isNull(), text).otherwise(F.array_join(F.transform(kept, lambda i: F.get(raw, i)), "\n"))
    out = [new.alias(n) if n == own[text_col] else F.col(n) for n in names]
    if dropped:
        out.append(F.coalesce(F.size("drop"), F.lit(0)).alias("__dropped"))
    return joined.select(*out).toDF(*docs.columns, *([dropped] if dropped else []))
