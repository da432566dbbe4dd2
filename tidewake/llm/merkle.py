"""Merkle manifest of a dataset: a digest for each row, one for each group, one for the whole, and proofs for every row.

A tree's shape follows from its size: leaves are numbered, every ``ARITY`` consecutive nodes have a parent, and the last run of
a level is shorter. Growing is event-driven, by key: a child's digest is an event for its parent (tree, level, number), which
collects digests by their spot in the run. Once a parent has as many as its arity, it becomes a digest itself and the next event.
Tasks first combine what they have, so most nodes are made where their leaves lie; what stays incomplete, the frontier, is a few
parents for each task and level. It is dealt by ancestors ``SPAN`` levels up and combined again, until the roots are made.

Proofs follow the links back: subtrees of SPAN levels get the path from their top to the root, and hand it down with their own
runs. A path is an array of (spot, kids): the run of digests at each level, and which of them is the node's own ancestor.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm.common import Scratch, lower_ascii, table
from tidewake.operators.numbering import laid_out

ARITY_BITS, SPAN = 3, 4
ARITY = 1 << ARITY_BITS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_PARTIAL = "tree long, level int, parent long, width long, spots binary, kids binary"
_PATH = "array<struct<spot: int, kids: binary>>"


def leaf(*columns: Column) -> Column:
    """The digest of a row's columns, in hex: each is its UTF-8 length, a colon and its value, a null a dash."""
    values = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in values]).cast("binary"), 256)


def _parts(step: Column) -> tuple[Column, Column]:
    """The siblings before and behind, in hex."""
    text = lambda c: F.lower(F.hex(c))
    return text(F.substring(step["kids"], F.lit(1), 32 * step["spot"])), text(F.substring(step["kids"], 32 * step["spot"] + 33, F.lit(32 * ARITY)))


def siblings(path: Column) -> Column:
    """All siblings of a path, from the leaf's run to the root's, left to right, in hex."""
    return F.array_join(F.transform(path, lambda s: F.concat(*_parts(s))), "")


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest (hex) and the siblings of a path lead to."""

    def up(below: Column, step: Column) -> Column:
        before, behind = _parts(step)
        return F.sha2(F.concat(before, below, behind).cast("binary"), 256)

    return F.aggregate(path, digest, up)


def _hash(run: bytes) -> bytes:
    return sha256(run.hex().encode()).digest()


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial parents in, finished ones (with a digest) and what is left of the others out."""
    open_: dict[tuple[int, int, int], dict[int, bytes]] = {}
    widths: dict[tuple[int, int], int] = {}
    names = ["tree", "level", "parent", "width", "spots", "kids", "digest"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    for b in batches:
        done = []
        for tree, level, parent, width, spots, kids in zip(*[b.column(n).to_pylist() for n in names[:-1]], strict=True):
            while True:
                key = (tree, level, parent)
                own = open_.setdefault(key, {})
                own.update((spot, kids[32 * k : 32 * k + 32]) for k, spot in enumerate(spots))
                widths[tree, level] = width
                arity = min(ARITY, width - ARITY * parent)
                if len(own) < arity:
                    break
                del open_[key]
                run = b"".join(own[k] for k in range(arity))
                digest = _hash(run)
                done.append((*key, width, bytes(range(arity)), run, digest))
                if width <= ARITY:
                    break  # the root of the tree
                # the parent is an event for its own parent
                spots, kids = bytes([parent & (ARITY - 1)]), digest
                level, parent, width = level + 1, parent >> ARITY_BITS, -(-width // ARITY)
        if done:
            yield out(done)
    left = [(*key, widths[key[:2]], bytes(own), b"".join(own.values()), None) for key, own in open_.items()]
    for k in range(0, len(left), 10_000):
        yield out(left[k : k + 10_000])


def grow(scratch: Scratch, name: str, leaves: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """Runs (tree, level, parent, kids), and roots (tree, digest), of trees of up to ``depth`` levels.

    leaves: (tree, at, n, digest), n the tree's leaves, ``at`` from 0. A tree of one leaf has no runs, its leaf is the root.
    """
    frontier = leaves.where("n > 1").select("tree", F.lit(0).alias("level"), F.shiftright("at", ARITY_BITS).alias("parent"), F.col("n").alias("width"), F.unhex(F.lpad(F.hex(F.col("at").bitwiseAND(ARITY - 1)), 2, "0")).alias("spots"), F.col("digest").alias("kids"))
    made = None
    for top in range(0, depth + SPAN, SPAN):
        if top:
            height = f"greatest({top}, level + 1)"
            frontier = frontier.repartition("tree", F.expr(height), F.expr(f"shiftright(parent, cast({ARITY_BITS} * ({height} - level - 1) as int))"))
        round_ = scratch.save(frontier.mapInArrow(_combine, _PARTIAL + ", digest binary"), f"{name}_{top}")
        done = round_.where("digest is not null")
        made = done if made is None else made.unionByName(done)
        frontier = round_.where("digest is null").drop("digest")
    roots = made.where(F.col("width") <= ARITY).select("tree", "digest").unionByName(leaves.where("n = 1").select("tree", "digest"))
    return made.select("tree", "level", "parent", "kids"), roots


def _levels(n: Column) -> Column:
    """Levels above the leaves of a tree of n of them."""
    out = F.lit(0)
    for k in range(1, 63 // ARITY_BITS + 1):
        out = out + (n > F.lit(1 << ARITY_BITS * (k - 1)).cast("long")).cast("int")
    return out


_ARROW_PATH = pa.list_(pa.struct([("spot", pa.int32()), ("kids", pa.binary())]))


def _links(table: pa.Table) -> tuple[dict[tuple[int, int], bytes], dict]:
    """A subtree's runs by (level, parent), and the path and root above its top."""
    is_top = table.column("path").is_valid()
    runs = table.filter(pc.invert(is_top))
    own = {(level, parent): kids for level, parent, kids in zip(*[runs.column(c).to_pylist() for c in ("level", "parent", "kids")], strict=True)}
    return own, table.filter(is_top).select(["path", "root"]).to_pylist()[0]


def _climb(runs: dict[tuple[int, int], bytes], above: list[dict], level: int, node: int) -> list[dict]:
    path = []
    while (kids := runs.get((level, node >> ARITY_BITS))) is not None:
        path.append({"spot": node & (ARITY - 1), "kids": kids})
        level, node = level + 1, node >> ARITY_BITS
    return path + above


def _hand_down(low: int):
    """Paths of the nodes at level ``low`` of one subtree, which become tops."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        runs, top = _links(table)
        nodes = [(parent << ARITY_BITS) + k for (level, parent), kids in runs.items() if level == low for k in range(len(kids) // 32)]
        paths = [_climb(runs, top["path"], low, node) for node in nodes]
        return pa.table([pa.array([key[0].as_py()] * len(nodes), pa.int64()), pa.array(nodes, pa.int64()), pa.array(paths, _ARROW_PATH), pa.array([top["root"]] * len(nodes), pa.binary())], ["tree", "anc", "path", "root"])

    return run


def _to_leaves(key: tuple, table: pa.Table, leaves: pa.Table) -> pa.Table:
    runs, top = _links(table)
    made = [_climb(runs, top["path"], 0, node) for node in leaves.column("at").to_pylist()]
    return leaves.drop_columns(["anc"]).append_column("path", pa.array(made, _ARROW_PATH)).append_column("root", pa.array([top["root"]] * leaves.num_rows, pa.binary()))


def proofs(scratch: Scratch, name: str, leaves: DataFrame, runs: DataFrame, entries: DataFrame, depth: int) -> DataFrame:
    """The leaves with ``path``, from their run to the end of their tree's entry, and ``root``, their tree's.

    leaves: (tree, at, n, ...). entries: (tree, n, path, root), the path above each tree's root, a row for each tree.
    A task holds subtrees of SPAN levels, one after another: 4,096 leaves and the runs above them, whatever the tree's size.
    """
    up = lambda top: F.expr(f"shiftright(parent, cast({ARITY_BITS} * ({top} - level - 1) as int))")
    entries = entries.withColumn("enters", F.greatest(F.lit(SPAN), F.ceil(_levels(F.col("n")) / SPAN) * SPAN))
    last = -(-max(depth, 1) // SPAN) * SPAN
    handed = None
    for top in range(last, 0, -SPAN):
        above = entries.where(F.col("enters") == top).select("tree", F.lit(0).cast("long").alias("anc"), "path", "root")
        if handed is not None:
            above = above.unionByName(handed)
        own = runs.where(F.col("level").between(top - SPAN, top - 1)).select("tree", up(top).alias("anc"), "level", "parent", "kids")
        links = own.unionByName(above, allowMissingColumns=True).groupBy("tree", "anc")
        if top > SPAN:
            handed = scratch.save(links.applyInArrow(_hand_down(top - SPAN), f"tree long, anc long, path {_PATH}, root binary"), f"{name}_down_{top}")
    held = leaves.withColumn("anc", F.shiftright("at", ARITY_BITS * SPAN))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in leaves.schema)
    return links.cogroup(held.groupBy("tree", "anc")).applyInArrow(_to_leaves, f"{schema}, path {_PATH}, root binary")


def _depth(n: int) -> int:
    depth = 0
    while n > 1:
        n, depth = -(-n // ARITY), depth + 1
    return depth


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "lang", id_col: str = "doc_id", claimed: Column | None = None) -> DataFrame:
    """(doc_id, group, leaf, claimed, subroot, root, path) of every row; digests in hex, the path up to the root of roots.

    A group's leaves ascend by id (nulls first, ties by their digest); groups are in order of their name, bytewise, null first.
    claimed: a digest (hex) of each row as someone else says it is, to be folded with ``path``; without it the leaf itself.
    Rows move as digests: once to be numbered, once to meet their subtree, where paths are made. No rows, no roots.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "merkle")
    own = leaf(*[F.col(f"`{c}`") for c in columns])
    other = F.lit(None).cast("string") if claimed is None else claimed
    base = docs.select(F.col(f"`{group}`").cast("string").alias("grp"), F.col(f"`{id_col}`").alias("doc_id"), F.unhex(own).alias("digest"), F.unhex(other).alias("claimed"))
    base = scratch.save(base.withColumn("spread", F.monotonically_increasing_id()), "leaves")
    rows = laid_out(base, [F.col(c) for c in ("doc_id", "digest", "spread")], ["grp"], scratch, "rows")
    # groups are leaves of the tree above, numbered the same way: a row each, found from the parts' edges
    sizes = rows.edges.groupBy("grp").agg(F.max(rows.names["every"]).alias("n"))
    groups = laid_out(sizes, [F.col("grp")], None, scratch, "groups")
    top = scratch.save(groups.places(groups.edges.withColumn("groups", F.col(groups.names["every"])), "tree"), "trees")
    most = top.agg(F.max("n").alias("n"), F.max("groups").alias("groups")).first()
    depth, height = _depth(most["n"] or 0), _depth(most["groups"] or 0)
    edges = rows.edges.alias("e").join(top.alias("t"), F.col("e.grp").eqNullSafe(F.col("t.grp"))).select("e.*", "t.tree", F.col("t.n").alias("size"))
    leaves = rows.places(edges, "at").select("tree", "at", F.col("size").alias("n"), "grp", "doc_id", "digest", "claimed")
    leaves = scratch.save(leaves, "numbered")
    runs, subroots = grow(scratch, "nodes", leaves, depth)
    groves = scratch.save(top.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.col("groups").alias("n"), F.col("n").alias("size")).join(subroots.select(F.col("tree").alias("at"), "digest"), "at"), "groves")
    above, root = grow(scratch, "groves_nodes", groves, height)
    start = root.select("tree", F.lit(None).cast("long").alias("n"), F.array().cast(_PATH).alias("path"), F.col("digest").alias("root")).withColumn("n", F.lit(int(most["groups"] or 0)).cast("long"))
    met = scratch.save(proofs(scratch, "groves", groves, above, start, height), "entries")
    entries = met.select(F.col("at").alias("tree"), F.col("size").alias("n"), "path", F.struct("digest", "root").alias("both"))
    # the root of all comes along with each tree's own
    entries = entries.select("tree", "n", "path", F.concat("both.digest", "both.root").alias("root"))
    got = proofs(scratch, "leaves", leaves, runs, entries, depth)
    text = lambda c: F.lower(F.hex(c))
    return got.select("doc_id", F.col("grp").alias(group), text(F.col("digest")).alias("leaf"), text(F.coalesce("claimed", "digest")).alias("claimed"),
                      text(F.substring("root", 1, 32)).alias("subroot"), text(F.substring("root", 33, 32)).alias("root"), "path")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = leaf(*[lower_ascii(F.col(c)) if c == "text" else F.col(c) for c in COLUMNS])
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    got = manifest(docs, claimed=F.when(hit, tampered))
    folded = got.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")).cast("binary"), 256).alias("proof_sha256"), fold(F.col("claimed"), F.col("path")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


OP11_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, n_chars, text FROM documents),
h AS (SELECT r, list_reduce(list_transform(range(1, 1 + length(doc_id::VARCHAR)), lambda k: ascii(substr(doc_id::VARCHAR, k::INT, 1))::BIGINT),
      lambda c, b: list_reduce(range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295::BIGINT) AS c FROM d WHERE doc_id IS NOT NULL),
f AS (SELECT d.*, CASE WHEN c IS NOT NULL AND xor(c, 4294967295) % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other FROM d LEFT JOIN h USING (r)),
b AS (SELECT r, doc_id, lang, concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
      coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head, text, other FROM f),
l AS (SELECT r, doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS told FROM b),
n AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM l),
t AS (SELECT g, 0 AS level, i, n, leaf AS h FROM n
      UNION ALL SELECT g, level + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY g, level, i // 8, n),
s AS (SELECT g AS i, h AS subroot FROM t WHERE n = 1),
u AS (SELECT 0 AS level, i, count(*) OVER () AS n, subroot AS h FROM s
      UNION ALL SELECT level + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY level, i // 8, n),
p AS (SELECT r, g, 0 AS level, i, n, told AS h, '' AS sib FROM n
      UNION ALL SELECT p.r, p.g, p.level + 1, p.i // 8, (p.n + 7) // 8, sha256(string_agg(CASE WHEN t.i = p.i THEN p.h ELSE t.h END, '' ORDER BY t.i)),
      p.sib || coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (WHERE t.i <> p.i), '') FROM p JOIN t ON t.g = p.g AND t.level = p.level AND t.i // 8 = p.i // 8
      WHERE p.n > 1 GROUP BY p.r, p.g, p.level, p.i, p.n, p.h, p.sib),
q AS (SELECT r, 0 AS level, g AS i, (SELECT count(*) FROM s) AS n, h, sib FROM p WHERE n = 1
      UNION ALL SELECT q.r, q.level + 1, q.i // 8, (q.n + 7) // 8, sha256(string_agg(CASE WHEN u.i = q.i THEN q.h ELSE u.h END, '' ORDER BY u.i)),
      q.sib || coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (WHERE u.i <> q.i), '') FROM q JOIN u ON u.level = q.level AND u.i // 8 = q.i // 8
      WHERE q.n > 1 GROUP BY q.r, q.level, q.i, q.n, q.h, q.sib)
SELECT n.doc_id, n.leaf, s.subroot, u.h AS root, sha256(q.sib) AS proof_sha256, q.h AS folded_root, q.h = u.h AS verified
FROM n JOIN s ON s.i = n.g JOIN q ON q.r = n.r AND q.n = 1 JOIN u ON u.n = 1
"""
