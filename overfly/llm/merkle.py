"""A Merkle manifest of a dataset: one hash tree per group, one tree over the groups' roots, and a proof for each row.

Trees are built from fragments. A fragment is a sparse forest: the nodes whose run of
siblings is not complete yet, keyed by tree, level and index. Merging two fragments
joins their nodes and resolves every run that this completes (its arity is known: a
level's node count says how many the last run has). Merging is associative and
commutative, and the empty forest changes nothing, so fragments may be merged in any
shape: partitions fold their rows, and a tree of merges folds the partitions. Nodes
that merges make stay in tables; no fragment goes through the driver.

Proofs are read off the node table from the roots down: a node's path is its siblings,
then its parent's path, joined run by run (eight rows at most), so no step depends on
how rows are spread over groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_arrow, with_rank

#: Contract value: siblings of a full run.
ARITY = 8
#: Fragments that one task merges in a round.
FAN = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NODE = "tree string, level int, idx long, n long, digest string"
STEP = "array<struct<before:string,after:string>>"
Node = tuple[str, int, int, int, str]


def above(digests: Iterable[str]) -> str:
    """The parent's digest: sha256 of the children's, as hex text, joined."""
    return hashlib.sha256("".join(digests).encode()).hexdigest()


class Forest:
    """Unresolved nodes: for each (tree, level, run) the level's node count and digests by index."""

    def __init__(self, arity: int = ARITY) -> None:
        self.arity = arity
        self.open: dict[tuple[str, int, int], tuple[int, dict[int, str]]] = {}

    def add(self, node: Node) -> list[Node]:
        """Take in a node; the nodes above it that now become known, lowest first. A tree's root (n = 1) is not kept."""
        made = []
        tree, level, idx, n, digest = node
        while n > 1:
            run = idx // self.arity
            want = min(self.arity, n - run * self.arity)
            _, have = self.open.setdefault((tree, level, run), (n, {}))
            have[idx] = digest
            if len(have) < want:
                break
            del self.open[tree, level, run]
            digest = above(have[i] for i in sorted(have))
            level, idx, n = level + 1, run, -(-n // self.arity)
            made.append((tree, level, idx, n, digest))
        return made

    def nodes(self) -> Iterator[Node]:
        for (tree, level, _), (n, have) in self.open.items():
            for idx, digest in have.items():
                yield tree, level, idx, n, digest

    def merge(self, other: Forest) -> list[Node]:
        """Join another fragment's nodes to this one; the nodes that this makes."""
        return [m for node in list(other.nodes()) for m in self.add(node)]


def _folded(d: DataFrame, arity: int) -> DataFrame:
    """One merge per partition of nodes that have a ``slot``: the nodes made, and those still open, all under the first slot seen."""
    names = [*[f.split()[0] for f in NODE.split(", ")], "slot", "made"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, slot = Forest(arity), None

        def out(nodes, made):
            columns = list(zip(*nodes)) or [[]] * 5
            types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([slot] * len(nodes), pa.int64()), pa.array([made] * len(nodes), pa.bool_())], names=names)

        for b in batches:
            if not b.num_rows:
                continue
            if slot is None:
                slot = b.column(5)[0].as_py()
            rows = zip(*[b.column(i).to_pylist() for i in range(5)])
            yield out([m for node in rows for m in forest.add(node)], True)
        yield out(list(forest.nodes()), False)

    return map_arrow(d.select(*names[:6]), run, f"{NODE}, slot long, made boolean")


def grow(leaves: DataFrame, arity: int = ARITY) -> DataFrame:
    """All nodes above ``leaves`` (tree, idx, n, digest), as ``NODE`` rows.

    ``n`` counts the tree's leaves, idx runs from 0. Leaves in order inside their
    partitions resolve as they pass, so a task holds a few open runs a level; in any
    other order the result is the same and a task may hold its partition's leaves.
    Rounds grow with the logarithm of the number of partitions; a round's tasks read
    what ``FAN`` fragments could not resolve. An empty table gives no rows.
    """
    d = leaves.select("tree", F.lit(0).alias("level"), "idx", "n", "digest")
    d = d.sortWithinPartitions("tree", "idx").withColumn("slot", F.spark_partition_id().cast("long"))
    made = []
    d = checkpointed(_folded(d, arity))
    slots = d.rdd.getNumPartitions()
    while True:
        made.append(d.filter("made").drop("slot", "made"))
        if slots <= 1:
            return reduce(DataFrame.unionAll, made)
        slots = -(-slots // FAN)
        # Open nodes of neighbouring partitions meet, as what they lack lies next to them.
        d = d.filter("not made").withColumn("slot", F.floor(F.col("slot") / FAN))
        d = checkpointed(_folded(d.repartition(slots, "slot").sortWithinPartitions("slot"), arity))


def roots(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tree, digest) of each tree's root; a lone leaf is its own."""
    return leaves.filter("n = 1").select("tree", "digest").unionAll(nodes.filter("n = 1").select("tree", "digest"))


def paths(leaves: DataFrame, nodes: DataFrame, start: DataFrame, keep: list[str], arity: int = ARITY) -> DataFrame:
    """``keep`` columns, digest, path and the columns of ``start`` for each leaf.

    ``start`` has a row per tree: tree, path (of its root, in whatever lies above) and
    columns to hand down. A path lists, from the leaf up, what stands before and after
    the node among its siblings.
    """
    given = [c for c in start.columns if c not in ("tree", "path")]
    height = nodes.agg(F.max("level")).first()[0] or 0
    known = None
    for level in range(height, -1, -1):
        more = keep if level == 0 else []
        rows = leaves.select("tree", "idx", "n", "digest", *keep) if level == 0 else nodes.filter(F.col("level") == level).drop("level")
        top = rows.filter("n = 1").join(start, "tree").select("tree", "idx", "digest", *more, "path", *given)
        if known is not None:
            member = F.struct("idx", "digest", *more)
            runs = rows.filter("n > 1").groupBy("tree", F.floor(F.col("idx") / arity).alias("run")).agg(F.array_sort(F.collect_list(member)).alias("m"))
            up = known.select(F.col("tree").alias("_tree"), F.col("idx").alias("_run"), F.col("path").alias("_up"), *given)
            j = runs.join(up, (F.col("tree") == F.col("_tree")) & (F.col("run") == F.col("_run")))
            j = j.select("tree", "_up", *given, F.col("m.digest").alias("all"), F.posexplode("m").alias("at", "one"))
            side = F.struct(
                F.array_join(F.slice("all", F.lit(1), F.col("at")), "").alias("before"),
                F.array_join(F.slice("all", F.col("at") + 2, F.lit(arity)), "").alias("after"),
            )
            top = top.unionByName(j.select("tree", "one.idx", "one.digest", *[F.col(f"one.{c}").alias(c) for c in more], F.concat(F.array(side), F.col("_up")).alias("path"), *given))
        known = top
    return known.drop("tree", "idx")


def proof(path: Column) -> Column:
    """The digest of all siblings of a path, joined."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda d, s: F.sha2(F.concat(s["before"], d, s["after"]), 256))


def field(c: Column) -> Column:
    """A value as the leaf's hash reads it: ``-`` for null, else its UTF-8 length, a colon and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def manifest(df: DataFrame, digest: Column, group: Column, order: Column, keep: dict[str, Column], arity: int = ARITY) -> DataFrame:
    """leaf, subroot, root, path and the ``keep`` columns of each row of ``df``.

    Rows form a tree per value of ``group`` (null: a tree of its own, first in order),
    ordered by ``order`` (null first) and, where that ties, by leaf, so rows that tie are
    either told apart or equal in all that their digest covers. Groups' roots form the
    last tree, in the order of their values' bytes. Very long texts are hashed where they
    lie; only digests travel. An empty table gives no rows.
    """
    tree = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))
    d = df.select(tree.alias("tree"), order.alias("_order"), digest.alias("digest"), *[c.alias(f"_k{i}") for i, c in enumerate(keep.values())])
    ks = [f"_k{i}" for i in range(len(keep))]
    leaves = checkpointed(with_rank(d, [F.col("tree")], [F.col("_order"), F.col("digest"), *ks], "idx", counts="n"))
    nodes = grow(leaves, arity)
    tops = with_rank(roots(leaves, nodes), [], [F.col("tree")], "idx", counts="n")
    tops = checkpointed(tops.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest", "idx", "n"))
    upper = grow(tops, arity)
    root = roots(tops, upper).select("tree", F.array().cast(STEP).alias("path"), F.col("digest").alias("root"))
    start = paths(tops, upper, root, ["of"], arity).select(F.col("of").alias("tree"), "path", F.col("digest").alias("subroot"), "root")
    start = checkpointed(start)
    out = paths(leaves, nodes, start, ks, arity)
    return out.select(*[F.col(k).alias(n) for k, n in zip(ks, keep)], F.col("digest").alias("leaf"), "subroot", "root", "path")


def tampered(doc_id: Column) -> Column:
    """Which rows are tampered with: 3 divides the CRC-32 of the decimal id (a missing id: no)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def verify_documents(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row of ``documents``.

    A third of the rows, by id, are checked with their text's A-Z in lower case; where
    there are none the row still verifies. Missing values count as such in the leaf;
    rows without an id come first; repeated rows are leaves of their own, equal rows
    interchangeable. Other columns are not looked at.
    """
    c = F.col
    rest = [c("doc_id"), c("source"), c("lang"), c("n_chars")]
    own = leaf(*rest, c("text"))
    seen = F.when(tampered(c("doc_id")), leaf(*rest, F.translate("text", UPPER, LOWER))).otherwise(own)
    d = manifest(docs, own, c("lang"), c("doc_id"), {"doc_id": c("doc_id"), "seen": seen})
    d = d.select("doc_id", "leaf", "subroot", "root", proof(c("path")).alias("proof_sha256"), folded(c("path"), c("seen")).alias("folded_root"))
    return d.withColumn("verified", c("folded_root") == c("root"))


def _oracle(levels: int = 8) -> str:
    """Level by level, each an aggregate over runs, and the siblings joined back; enough for arity ** levels leaves."""
    fields = lambda text: " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text))
    crc_rule = (
        "crc_rule AS (SELECT i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_rule WHERE k < 8), "
        "crc_table AS (SELECT list(c ORDER BY i) AS tbl FROM crc_rule WHERE k = 8)"
    )
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(ch)::BIGINT FOR ch IN string_split(doc_id::VARCHAR, '')]), lambda c, b: xor(c >> 8, tbl[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295::BIGINT)"

    def trees(prefix: str, source: str) -> list[str]:
        """CTEs prefix0 .. of nodes (g, i, n, h), and prefix_step of each leaf's siblings (l, before, after) by its index."""
        out = [f"{prefix}0 AS (SELECT g, i, n, h FROM {source})"]
        for k in range(levels):
            out.append(
                f"{prefix}{k + 1} AS (SELECT g, i // {ARITY} AS i, any_value((n + {ARITY - 1}) // {ARITY}) AS n, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {prefix}{k} WHERE n > 1 GROUP BY g, i // {ARITY})"
            )
            out.append(
                f"{prefix}s{k} AS (SELECT g, i, coalesce(string_agg(h, '') OVER (PARTITION BY g, i // {ARITY} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,"
                f" coalesce(string_agg(h, '') OVER (PARTITION BY g, i // {ARITY} ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {prefix}{k} WHERE n > 1)"
            )
        out.append(f"{prefix}_root AS ({' UNION ALL '.join(f'SELECT g, h FROM {prefix}{k} WHERE n = 1' for k in range(levels + 1))})")
        return out

    fold, sides, joins = "seen", [], []
    for p, idx, g in (("a", "o.i", "o.g"), ("b", "t.i", "0")):
        for k in range(levels):
            s = f"{p}{k}_"
            joins.append(f"LEFT JOIN {p}s{k} AS {s} ON {s}.g IS NOT DISTINCT FROM {g} AND {s}.i = {idx} // {ARITY**k}")
            sides.append(f"coalesce({s}.before || {s}.after, '')")
    # Folding is one column more for each level, as a digest may not be written out twice.
    folds, last = [], "f0"
    for j, p in enumerate([f"a{k}_" for k in range(levels)] + [f"b{k}_" for k in range(levels)]):
        folds.append(f"f{j + 1} AS (SELECT *, CASE WHEN {p}before IS NULL THEN x{j} ELSE sha256({p}before || x{j} || {p}after) END AS x{j + 1} FROM f{j})")
        last = f"f{j + 1}"
    keep = ", ".join(f"{p}{k}_.before AS {p}{k}_before, {p}{k}_.after AS {p}{k}_after" for p in "ab" for k in range(levels))
    ctes = [
        crc_rule,
        f"d AS (SELECT doc_id, lang, sha256({fields('text')}) AS leaf, coalesce({crc} % 3 = 0, false) AS hit, sha256({fields(f"translate(text, '{UPPER}', '{LOWER}')")}) AS other FROM documents, crc_table)",
        "o AS (SELECT doc_id, lang AS g, leaf AS h, CASE WHEN hit THEN other ELSE leaf END AS seen, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d)",
        *trees("a", "o"),
        "t AS (SELECT 0 AS g, g AS lang, h, row_number() OVER (ORDER BY encode(g) NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM a_root)",
        *trees("b", "t"),
        f"f0 AS (SELECT o.doc_id, o.h AS leaf, t.h AS subroot, b_root.h AS root, sha256({' || '.join(sides)}) AS proof_sha256, o.seen AS x0, {keep} FROM o JOIN t ON t.lang IS NOT DISTINCT FROM o.g JOIN b_root ON b_root.g = 0 {' '.join(joins)})",
        *folds,
    ]
    return f"WITH RECURSIVE {', '.join(ctes)} SELECT doc_id, leaf, subroot, root, proof_sha256, x{2 * levels} AS folded_root, x{2 * levels} = root AS verified FROM {last}"


ORACLE = _oracle()
