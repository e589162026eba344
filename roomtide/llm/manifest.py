"""A Merkle manifest of a table: a root digest for all rows, and for each row the proof that it is in.

Rows are leaves. Within each group (the language) they stand in order, and every FANOUT consecutive nodes have one parent
until one node is left, the subroot; subroots in the order of their groups have the root above them in the same way.

A level is pivoted by slots: conditional aggregates spread the children of a parent into FANOUT columns. All columns
together are hashed to the parent; without the own column they are a node's siblings. Proofs are handed down from the
root: each pivoted row gets the siblings above it by one join of its level, and its children, taken out of the columns
again, get their own beside them. So the rows themselves, most of the nodes, are shuffled twice (into order, into their
parents' rows) and never joined with digests.

A node's place in its group comes from a range sort by group and order: places within a sorted part, and sums of the
parts before it, of which there is one for each part and group. A group with most of the rows is dealt over parts
like the rest.

Fields are hashed as their UTF-8 byte count, a colon and the value; a null as a hyphen. Defined cases: null is a group
of its own, before all others; null doc_ids come first in a group and are not tampered; rows that share a doc_id are leaves each,
ordered by digest; equal rows have equal digests, and either may have either proof. An empty table has no root
and no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomtide.llm.common import buckets, written

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Every document whose checksum this divides is tampered with, to be found out.
TAMPERED_EVERY = 3

#: The siblings of a node and its ancestors, lowest first: their digests left and right of it.
PATH = "array<struct<left: string, right: string>>"


def digest(text: Column) -> Column:
    """Lowercase hex."""
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """A value such that no two rows of values are written alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(columns: Sequence[Column]) -> Column:
    return digest(F.concat(*[field(c) for c in columns]))


def in_place(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """The rows, written, with their place in their group (`_at`, from 0) and its number of rows (`_n`).

    `group` has no nulls. Rows that `order` does not tell apart are dealt over parts by `_row`, a number of their own.
    """
    keys = [group, *order, "_row"]
    spark = rows.sparkSession
    parts = rows.repartitionByRange(buckets(spark, 1), *keys).sortWithinPartitions(*keys)
    # The upper 31 bits of this number are the part, the lower 33 count its rows.
    placed = written(parts.withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_row", 33)))
    found = placed.groupBy(group, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("_rows").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = found.select(group, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(whole).alias("_n"))
    # Written, so that its true size tells whether it is broadcast.
    return placed.join(written(found), [group, "_part"]).withColumn("_at", F.col("_row") + F.col("_shift")).drop("_part", "_shift")


def pivoted(nodes: DataFrame, kept: Sequence[str]) -> DataFrame:
    """One row per parent (group, `_n`, `_at`) with the columns `<name>_<slot>` of its children, for each of `kept`."""
    slot = F.col("_at") % FANOUT
    columns = [F.max(F.when(slot == k, F.col(name))).alias(f"{name}_{k}") for k in range(FANOUT) for name in kept]
    return nodes.groupBy("_group", "_n", F.floor(F.col("_at") / FANOUT).alias("_at")).agg(*columns)


def joined(slots: Sequence[int]) -> Column:
    """The digests in some slots, in order; an empty slot adds nothing."""
    return F.concat_ws("", *[f"_hash_{k}" for k in slots]) if slots else F.lit("")


def children(parents: DataFrame, kept: Sequence[str], others: Sequence[str]) -> DataFrame:
    """The children of pivoted rows with a path above (`_path`), each with its own siblings before that path."""

    def child(k: int) -> Column:
        own = F.struct(joined(range(k)).alias("left"), joined(range(k + 1, FANOUT)).alias("right"))
        return F.struct(
            (F.col("_at") * FANOUT + k).alias("_place"),
            *[F.col(f"{name}_{k}").alias(name) for name in kept],
            F.concat(F.array(own), F.col("_path")).alias("_above"),
        )

    each = parents.select("_group", *others, F.inline(F.array(*[child(k) for k in range(FANOUT)])))
    return each.filter("_hash IS NOT NULL").withColumnsRenamed({"_place": "_at", "_above": "_path"})


def with_paths(
    leaves: DataFrame, payload: Sequence[str], added: Sequence[str], top_of: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """The leaves (`_hash` and the payload) with the columns `added` and `_path`, their siblings up to the root of all groups.

    `leaves` has `_group`, `_n`, `_at`, `_hash` and the payload. `top_of` gets a row for each group, with the digest of
    its subroot (`_hash`), and gives these rows with `added` and `_path`, what is above the subroot.
    """
    most = leaves.agg(F.max("_n")).first()[0] or 0
    height = next(h for h in range(64) if FANOUT**h >= most)  # of the largest group
    subroots, levels, nodes, kept = [], [], leaves, [["_hash", *payload]] + height * [["_hash"]]
    for h in range(height + 1):
        count = F.ceil(F.col("_n") / FANOUT**h)  # of the group's nodes on this level
        subroots.append(nodes.filter(count == 1).select("_group", "_hash", F.lit(h).alias("_height")))
        if h < height:
            levels.append(written(pivoted(nodes.filter(count > 1), kept[h])))
            nodes = levels[h].select("_group", "_n", "_at", digest(joined(range(FANOUT))).alias("_hash"))
    tops = written(top_of(reduce(DataFrame.unionByName, subroots)))
    carried = [*added, "_path"]
    alone = leaves.join(tops.filter("_height = 0").select("_group", *carried), "_group")
    below = None
    for h in range(height, 0, -1):
        above = tops.filter(F.col("_height") == h).select("_group", F.lit(0).cast("long").alias("_at"), *carried)
        above = above if below is None else above.unionByName(below.select("_group", "_at", *carried))
        below = children(levels[h - 1].join(above, ["_group", "_at"]), kept[h - 1], added)
    columns = ["_hash", *payload, *carried]
    return alone.select(columns) if below is None else alone.select(columns).unionByName(below.select(columns))


def proven(leaves: DataFrame, order: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Leaves (`_group`, which has no nulls, `_hash`, the payload) with `subroot`, `root` and `_path`."""

    def over_groups(subroots: DataFrame) -> DataFrame:
        rows = subroots.select(F.lit("").alias("_group"), F.col("_group").alias("_name"), "_hash", "_height")
        rows = in_place(rows.withColumn("_row", F.lit(0).cast("long")), "_group", ["_name"])
        found = with_paths(rows, ["_name", "_height"], ["root"], lambda top: top.select("*", F.col("_hash").alias("root"), F.array().cast(PATH).alias("_path")))
        return found.select(F.col("_name").alias("_group"), "_height", F.col("_hash").alias("subroot"), "root", "_path")

    return with_paths(in_place(leaves, "_group", order), payload, ["subroot", "root"], over_groups)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda node, step: digest(F.concat(step.left, node, step.right)))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda step: F.concat(step.left, step.right)), ""))


def merkle_manifest(
    docs: DataFrame, group: str = "lang", order: str = "doc_id", fields: Sequence[str] = FIELDS, other: Column | None = None
) -> DataFrame:
    """One row per row: `order`, `leaf`, `subroot`, `root`, `path`, the siblings from the leaf up as (left, right), and
    `other_leaf`, the digest of `fields` with `other` in place of the last, where `other` is not null."""
    plain = [F.col(f) for f in fields]
    changed = F.lit(None).cast("string") if other is None else F.when(other.isNotNull(), row_digest([*plain[:-1], other]))
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("_group"),
        F.col(order).alias("_order"),
        row_digest(plain).alias("_hash"),
        changed.alias("_other"),
        F.monotonically_increasing_id().alias("_row"),
    )
    found = proven(written(leaves), ["_order", "_hash"], ["_order", "_other"])
    names = {"_order": order, "_hash": "leaf", "subroot": "subroot", "root": "root", "_path": "path", "_other": "other_leaf"}
    return found.select(*(F.col(k).alias(v) for k, v in names.items()))


def verified_rows(docs: DataFrame) -> DataFrame:
    """The manifest of the documents, checked against a copy in which some texts lost their capital letters."""
    capitals = "".join(map(chr, range(65, 91)))
    small = F.translate("text", capitals, capitals.lower())
    found = merkle_manifest(docs, other=F.when(F.crc32(F.col("doc_id").cast("string")) % TAMPERED_EVERY == 0, small))
    again = folded(F.coalesce("other_leaf", "leaf"), F.col("path"))
    rows = found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), again.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11(spark, folder: str) -> DataFrame:
    return verified_rows(spark.read.parquet(f"{folder}/documents.parquet"))


def _sql() -> str:
    """Levels by grouping runs, up to 8^10 rows of a group or groups; the remainder of a division for the checksum."""
    field = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode(CAST({0} AS VARCHAR))) || ':' || {0} END"
    leaf = lambda text: "sha256(" + " || ".join(field.format(f) for f in FIELDS[:-1]) + " || " + field.format(text) + ")"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    eight = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    bytes_ = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))"
    checksum = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda c, b: {eight}), 4294967295)"

    def tree(name: str, base: str, keys: str) -> list[str]:
        """Nodes of each level, whole runs of each level, for rows of `base` with keys, spot, n, hash."""
        out = [f"{name}0 AS (SELECT {keys}, spot, n, hash FROM {base})"]
        for h in range(10):
            out.append(f"""{name}r{h} AS (SELECT {keys}, spot // 8 AS spot, any_value(n) AS n, list(hash ORDER BY spot) AS run
                FROM {name}{h} GROUP BY {keys}, spot // 8)""")
            out.append(f"""{name}{h + 1} AS (SELECT {keys}, spot, (n + 7) // 8 AS n,
                CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS hash FROM {name}r{h})""")
        return out

    def climb(name: str, source: str, keys: list[str], place: str) -> list[str]:
        """Rows of `source` with `proof` and `fold` carried over the levels of a tree."""
        out, before = [], source
        for h in range(10):
            slot = f"((d.{place} // {8**h}) % 8)"
            left, right = f"array_to_string(run[1:{slot}], '')", f"array_to_string(run[{slot} + 2:], '')"
            same = " AND ".join([f"r.{k} IS NOT DISTINCT FROM d.{k}" for k in keys] + [f"r.spot = d.{place} // {8 ** (h + 1)}"])
            out.append(f"""{source}_{name}{h} AS (SELECT d.* REPLACE (
                CASE WHEN r.n = 1 THEN proof ELSE proof || {left} || {right} END AS proof,
                CASE WHEN r.n = 1 THEN fold ELSE sha256({left} || fold || {right}) END AS fold)
                FROM {before} d JOIN {name}r{h} r ON {same})""")
            before = f"{source}_{name}{h}"
        return out

    parts = [
        f"""leaves AS (SELECT doc_id, lang, {leaf("text")} AS hash,
            CASE WHEN doc_id IS NOT NULL AND {checksum} % 3 = 0 THEN {leaf(lowered)} ELSE {leaf("text")} END AS fold FROM documents)""",
        """placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, hash) - 1 AS spot,
            count(*) OVER (PARTITION BY lang) AS n FROM leaves)""",
        *tree("t", "placed", "lang"),
        """subroots AS (SELECT lang, hash, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS spot, count(*) OVER () AS n, 0 AS one FROM t10)""",
        *tree("g", "subroots", "one"),
        """start AS (SELECT p.doc_id, p.lang, p.hash, p.fold, '' AS proof, p.spot, s.spot AS place, 0 AS one, s.hash AS subroot
            FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang)""",
        *climb("t", "start", ["lang"], "spot"),
        *climb("g", "start_t9", ["one"], "place"),
    ]
    return f"""WITH {", ".join(parts)}
SELECT doc_id, hash AS leaf, subroot, (SELECT hash FROM g10) AS root, sha256(proof) AS proof_sha256, fold AS folded_root,
       fold = (SELECT hash FROM g10) AS verified
FROM start_t9_g9"""


SQL = _sql()
