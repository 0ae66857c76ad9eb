"""Operator 11: Merkle manifest of a dataset over concatenated-level strings.

Every row of ``documents`` is a leaf.  Leaves of a source ascend by id; 16
consecutive nodes of a level make one node of the next, up to the source's
subroot, and the subroots of all sources make the root the same way.

A tree is built in blocks of 256 consecutive, aligned nodes.  A block keeps each
of its levels as one hex string: fixed-width substrings of it are the runs whose
hashes make the next level, and the substrings on both sides of a node are its
siblings.  The block's last node is a leaf of the next round, so a source with a
third of all rows is many blocks, never one long string.
Going down again, every block gets the siblings above it once and its rows add
their own flanks; nobody holds more than a block.

A leaf's place comes from nested running sums over id ranges, so no window holds
a source.  Rows alike in every hashed column are one counted row until then.

Cases: a null column hashes as ``-``; a null source is a source of its own and
comes first; null ids come first in their source; rows that share an id ascend
by leaf; equal rows are leaves next to each other; a source of one leaf has that
leaf as subroot, a table of one source that subroot as root, and a leaf without
siblings anywhere the hash of nothing as proof.  A row without an id is never
tampered with.  An empty table gives no rows.  Further columns are not hashed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.prefix import nested_running_sum, segmented_running_sum
from .common import UPPER, crc_mod, written

FANOUT = 16
BLOCK = FANOUT * FANOUT
HEX = 64
RUN = FANOUT * HEX
COPY_RUN = 4096
SPLIT_POINTS = 256
TAMPER_EVERY = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, ``:`` and the value."""
    s = value.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_hash(**changed: Column) -> Column:
    return F.sha2(F.concat(*[field(changed.get(c, F.col(c))) for c in FIELDS]), 256)


def tampered() -> Column:
    """The text with A-Z lower-cased where 5 divides the id's crc32."""
    return F.when(crc_mod("doc_id", TAMPER_EVERY) == 0, F.translate("text", UPPER, UPPER.lower()))


def leaves(docs: DataFrame, changed_text: Column | None = None) -> DataFrame:
    """``seg`` (source), ``doc_id``, ``leaf`` and ``other``, the leaf of the row
    with ``changed_text`` instead of its text (null where nothing changed), once
    per distinct row, with its number of ``copies``."""
    changed = F.lit(None).cast("string") if changed_text is None else changed_text
    other = F.when(changed.isNotNull(), leaf_hash(text=changed))
    return (docs.select(F.col("source").alias("seg"), "doc_id", leaf_hash().alias("leaf"), other.alias("other"))
            .groupBy("seg", "doc_id", "leaf", "other").agg(F.count(F.lit(1)).alias("copies")))


def placed(rows: DataFrame) -> DataFrame:
    """``leaves`` with ``pos``, the place in the source: first the ids in ranges
    of 2^46, 2^34, 2^22 and 2^10, then those of one id by their hash's beginning."""
    levels = {f"_r{b}": F.shiftright("doc_id", b) for b in (46, 34, 22, 10)}
    levels["_same"] = F.struct("doc_id", F.substring("leaf", 1, 3))
    d = nested_running_sum(rows, ["seg"], ["doc_id", "leaf", "other"], levels, {"pos": F.col("copies")})
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPY_RUN)))
    d = d.select("*", runs.alias("_run"))
    one = F.explode(F.sequence(F.col("_run") * COPY_RUN, F.least("copies", (F.col("_run") + 1) * COPY_RUN) - 1))
    return d.select("*", one.alias("_one")).select("seg", "doc_id", "leaf", "other", (F.col("pos") + F.col("_one")).alias("pos"))


def parents(level: Column) -> Column:
    """The next level's string: the hash of every run of 16 nodes, on end."""
    n = F.floor((F.length(level) - 1) / RUN).cast("int")
    hashes = F.transform(F.sequence(F.lit(0), n), lambda i: F.sha2(F.substring(level, i * RUN + 1, F.lit(RUN)), 256))
    return F.array_join(hashes, "").cast("binary")


def flanks(level: Column, i: Column) -> tuple[Column, Column]:
    """The siblings before and after node ``i`` of a level string."""
    at = i * HEX
    run = at - at % RUN
    left = F.substring(level, run + 1, at - run).cast("string")
    return left, F.substring(level, at + HEX + 1, run + RUN - at - HEX).cast("string")


def build(nodes: DataFrame, sizes: DataFrame, name: str) -> list[DataFrame]:
    """Blocks of all rounds of the trees of ``nodes`` (``seg, pos, leaf`` and
    further columns); ``sizes`` holds ``seg, n``.  A block: ``seg, block, items``
    (in order), ``depth`` (levels it adds), its level strings ``l0, l1``, its last
    ``node`` and ``n``, the nodes of its source.  The last round holds one block a source."""
    most, rounds = sizes.agg(F.max("n")).first()[0] or 0, []
    s = sizes.select(F.col("seg").alias("_s"), "n")
    while not rounds or most > 1:
        items = F.sort_array(F.collect_list(F.struct("pos", "leaf", *[c for c in nodes.columns if c not in ("seg", "pos", "leaf")])))
        b = (nodes.groupBy("seg", F.floor(F.col("pos") / BLOCK).alias("block")).agg(items.alias("items"))
             .withColumn("l0", F.array_join("items.leaf", "").cast("binary")))
        b = (b.join(s, b["seg"].eqNullSafe(s["_s"])).drop("_s")
             .withColumn("depth", F.when(F.col("n") <= 1, 0).when(F.col("n") <= FANOUT, 1).otherwise(2))
             .withColumn("l1", F.when(F.col("depth") >= 1, parents(F.col("l0")))))
        last = F.when(F.col("depth") == 0, F.col("l0")).when(F.col("depth") == 1, F.col("l1")).otherwise(parents(F.col("l1")))
        rounds.append(written(b.withColumn("node", last.cast("string")), f"{name}-{len(rounds)}"))
        nodes = rounds[-1].select("seg", F.col("block").alias("pos"), F.col("node").alias("leaf"))
        s = s.withColumn("n", F.ceil(F.col("n") / BLOCK))
        most = -(-most // BLOCK)
    return rounds


def descend(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Rows of the first round's items (``item``) with ``l0, r0, l1, r1, depth``,
    their siblings inside the block, and ``above``, the (left, right) siblings
    from there to the end of ``tops`` (``seg, above`` and further columns)."""
    keep = [c for c in tops.columns if c not in ("seg", "above")]
    tops = tops.withColumn("pos", F.lit(0).cast("long"))
    for k in range(len(rounds) - 1, -1, -1):
        t = tops.select(F.col("seg").alias("_s"), F.col("pos").alias("_p"), "above", *keep)
        b = rounds[k].drop("node", "n")
        b = b.join(t, b["seg"].eqNullSafe(t["_s"]) & (b["block"] == t["_p"])).drop("_s", "_p")
        d = b.select("seg", "depth", "above", *keep, "l0", "l1", F.posexplode("items").alias("i", "item"))
        (left0, right0), (left1, right1) = flanks(F.col("l0"), F.col("i")), flanks(F.col("l1"), F.floor(F.col("i") / FANOUT).cast("int"))
        d = d.select("seg", "item", "above", *keep, "depth", left0.alias("l0"), right0.alias("r0"), left1.alias("l1"), right1.alias("r1"))
        if k:
            pair = lambda a, b: F.array(F.struct(F.col(a).alias("left"), F.col(b).alias("right")))
            none = F.slice(pair("l0", "r0"), 1, 0)
            own = F.concat(F.when(F.col("depth") >= 1, pair("l0", "r0")).otherwise(none),
                           F.when(F.col("depth") >= 2, pair("l1", "r1")).otherwise(none))
            tops = d.select("seg", F.col("item.pos").alias("pos"), F.concat(own, "above").alias("above"), *keep)
    return d


def fold(start: Column) -> Column:
    """The root that a leaf and its siblings lead to, on the rows of ``descend``."""
    own = F.when(F.col("depth") == 0, start).otherwise(F.sha2(F.concat("l0", start, "r0"), 256))
    own = F.when(F.col("depth") == 2, F.sha2(F.concat("l1", own, "r1"), 256)).otherwise(own)
    return F.aggregate("above", own, lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))


def siblings() -> Column:
    """All siblings of a row of ``descend``, level by level, as one string."""
    return F.concat(F.when(F.col("depth") >= 1, F.concat("l0", "r0")).otherwise(""),
                    F.when(F.col("depth") >= 2, F.concat("l1", "r1")).otherwise(""),
                    F.array_join(F.transform("above", lambda p: F.concat(p["left"], p["right"])), ""))


def source_places(subroots: DataFrame) -> DataFrame:
    """``seg, leaf`` with ``pos``, the source's place among all (null first).
    The 256 sources of least hash cut all into ranges of about equal size."""
    points = subroots.filter(F.col("seg").isNotNull()).select("seg").orderBy(F.xxhash64("seg"), "seg").limit(SPLIT_POINTS)
    cuts = F.array(*[F.lit(r["seg"]) for r in points.collect()]).cast("array<string>")
    rank = F.when(F.col("seg").isNull(), -1).otherwise(F.size(F.filter(cuts, lambda c: c <= F.col("seg"))))
    return segmented_running_sum(subroots.withColumn("all", F.lit(0)), ["all"], ["seg"], {"_range": rank},
                                 {"pos": F.lit(1).cast("long")}).select("seg", "leaf", "pos")


def manifest(docs: DataFrame, changed_text: Column | None = None) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, source, lang, n_chars, text``):
    ``doc_id, source, leaf, subroot, root, proof`` (siblings from the leaf to the
    root on end, level by level) and ``folded_root``, to which the siblings lead
    from the leaf, or, where ``changed_text`` is not null, from the leaf of the
    row with that text."""
    rows = written(leaves(docs, changed_text), "merkle-leaves")
    sizes = written(rows.groupBy("seg").agg(F.sum("copies").alias("n")), "merkle-sizes")
    rounds = build(placed(rows), sizes, "merkle")
    subroots = rounds[-1].select("seg", F.col("node").alias("leaf"))
    every = source_places(subroots).select(F.lit("").alias("seg"), "pos", "leaf", F.col("seg").alias("of"))
    top = build(every, every.groupBy("seg").agg(F.count(F.lit(1)).alias("n")), "merkle-top")
    root = top[-1].select("seg", F.array().cast("array<struct<left:string,right:string>>").alias("above"), F.col("node").alias("root"))
    up = descend(top, root)
    pairs = F.slice(F.array(F.struct(F.col("l0").alias("left"), F.col("r0").alias("right")),
                            F.struct(F.col("l1").alias("left"), F.col("r1").alias("right"))), F.lit(1), F.col("depth"))
    tops = written(up.select(F.col("item.of").alias("seg"), F.concat(pairs, "above").alias("above"),
                             F.col("item.leaf").alias("subroot"), "root"), "merkle-tops")
    d = descend(rounds, tops)
    return d.select(F.col("item.doc_id").alias("doc_id"), F.col("seg").alias("source"), F.col("item.leaf").alias("leaf"), "subroot", "root",
                    siblings().alias("proof"), fold(F.coalesce("item.other", "item.leaf")).alias("folded_root"))


# crc32 bit by bit, as DuckDB has no such function
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""


def _tree_sql(name: str, base: str) -> str:
    """CTEs ``{name}_nodes`` (all levels), ``{name}_runs`` and ``{name}_walk``
    (the way up of every base row) over ``base`` (s, pos, h, n, start)."""
    return f"""
{name}_nodes(s, k, pos, h, n) AS (
  SELECT s, 0, pos, h, n FROM {base}
  UNION ALL
  SELECT s, k + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), max((n + 15) // 16)
  FROM {name}_nodes WHERE n > 1 GROUP BY s, k, pos // 16),
{name}_runs AS (SELECT s, k, pos // 16 AS run, list(h ORDER BY pos) AS hs FROM {name}_nodes WHERE n > 1 GROUP BY ALL),
{name}_walk(s, place, pos, k, proof, folded) AS (
  SELECT s, pos, pos, 0, '', start FROM {base}
  UNION ALL
  SELECT w.s, w.place, w.pos // 16, w.k + 1,
         proof || array_to_string(hs[1:w.pos % 16], '') || array_to_string(hs[w.pos % 16 + 2:], ''),
         sha256(array_to_string(hs[1:w.pos % 16], '') || folded || array_to_string(hs[w.pos % 16 + 2:], ''))
  FROM {name}_walk w JOIN {name}_runs r ON r.s = w.s AND r.k = w.k AND r.run = w.pos // 16),
{name}_ends AS (SELECT s, place, max(k) AS k, arg_max(proof, k) AS proof, arg_max(folded, k) AS folded FROM {name}_walk GROUP BY s, place)"""


def _field_sql(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


_HASH_SQL = " || ".join(_field_sql(c) for c in FIELDS)
ORACLE_SQL = f"""
WITH RECURSIVE raw AS (
  SELECT *, {_CRC} AS crc, translate(text, '{UPPER}', '{UPPER.lower()}') AS low FROM documents),
hashed AS (
  SELECT doc_id, source, sha256({_HASH_SQL}) AS h,
         CASE WHEN crc % 5 = 0 AND text IS NOT NULL THEN sha256({_HASH_SQL.replace("text", "low")}) END AS other FROM raw),
leafs AS (
  SELECT doc_id, h, coalesce(other, h) AS start, dense_rank() OVER (ORDER BY source NULLS FIRST) AS s,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM hashed),
{_tree_sql("src", "leafs")},
subroots AS (
  SELECT 0 AS s, s - 1 AS pos, arg_max(h, k) AS h, count(*) OVER () AS n, arg_max(h, k) AS start FROM src_nodes WHERE n = 1 GROUP BY s),
{_tree_sql("top", "subroots")},
root AS (SELECT arg_max(h, k) AS h FROM top_nodes WHERE n = 1),
-- the way from the subroot to the root, from the subroot each leaf leads to
below AS (SELECT l.doc_id, l.h, l.s, e.proof, e.folded FROM leafs l JOIN src_ends e ON e.s = l.s AND e.place = l.pos),
up(i, doc_id, h, s, pos, k, proof, folded) AS (
  SELECT row_number() OVER (), doc_id, h, s, s - 1, 0, proof, folded FROM below
  UNION ALL
  SELECT i, doc_id, h, w.s, pos // 16, w.k + 1,
         proof || array_to_string(hs[1:pos % 16], '') || array_to_string(hs[pos % 16 + 2:], ''),
         sha256(array_to_string(hs[1:pos % 16], '') || folded || array_to_string(hs[pos % 16 + 2:], ''))
  FROM up w JOIN top_runs r ON r.k = w.k AND r.run = pos // 16),
done AS (
  SELECT any_value(doc_id) AS doc_id, any_value(h) AS leaf, any_value(s) AS s, arg_max(proof, k) AS proof, arg_max(folded, k) AS folded
  FROM up GROUP BY i)
SELECT d.doc_id, d.leaf, b.h AS subroot, r.h AS root, sha256(d.proof) AS proof_sha256, d.folded AS folded_root, d.folded = r.h AS verified
FROM done d JOIN subroots b ON b.pos = d.s - 1, root r
"""
