"""Mixing sources to target weights by hierarchical budgets.

Documents are leaves of a tree domain - language - source. A budget of tokens is shared out from the root by the weights of
siblings; a leaf can take its tokens ``max_epochs`` times at most, and what a node can't take goes to its siblings by their
weights, and to its parent's siblings only when all of them are full. A leaf then takes whole epochs and of the next epoch,
ordered by a seeded hash, the longest prefix that fits its budget.

The prefix is found without ordering a leaf in one task: tokens are summed by the hash's first two digits, which gives the
slice in which the budget ends, that slice by the next two, and only what is left (about 1/65536 of the leaf) row by row.
The result is one hash value for each leaf, so choosing documents is a filter over the table and texts never move.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake.llm.bpe import count_tokens
from tidewake.llm.common import Scratch, fresh, table

#: What a leaf table may hold: it is collected and broadcast.
MOST_LEAVES = 100_000
#: Hexadecimal digits of the order by which tokens are summed, one step after the other.
STEPS = (2, 2)
#: The production mix: weights by level; names that aren't listed weigh 1.
DOMAINS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANGS = {"en": 4, "de": 2, "fr": 2, "es": 2}


def share(budget: int, weights: list[Fraction], caps: list[int]) -> list[int]:
    """budget by weights, no more than the caps; what a full one leaves goes to the others by weight. Whole numbers; the parts left by rounding go to the largest remainders, then to the first."""
    got, budget = [Fraction(0)] * len(caps), min(budget, sum(caps))
    open_, left = [k for k in range(len(caps)) if weights[k] > 0], Fraction(budget)
    while open_ and left > 0:
        total = sum(weights[k] for k in open_)
        full = [k for k in open_ if weights[k] * left >= (caps[k] - got[k]) * total]
        if not full:
            for k in open_:
                got[k] += weights[k] * left / total
            left = Fraction(0)
            break
        for k in full:
            left -= caps[k] - got[k]
            got[k] = Fraction(caps[k])
        open_ = [k for k in open_ if k not in full]
    whole = [int(g) for g in got]
    spare = int(sum(got)) - sum(whole)
    for k in sorted(range(len(got)), key=lambda k: (whole[k] - got[k], k))[:spare]:
        whole[k] += 1
    return whole


def budgets(leaves: dict[tuple, int], total: int, weights: list[dict], max_epochs: int) -> dict[tuple, int]:
    """Tokens for each leaf (a path of names) of a tree whose leaves hold so many tokens."""
    caps = {p: n * max_epochs for p, n in leaves.items()}

    def down(paths: list[tuple], depth: int, budget: int) -> dict[tuple, int]:
        if len(paths[0]) == depth:
            return {paths[0]: budget}
        names = sorted({p[depth] for p in paths})
        under = {n: [p for p in paths if p[depth] == n] for n in names}
        parts = share(budget, [Fraction(weights[depth].get(n, 1)) for n in names], [sum(caps[p] for p in under[n]) for n in names])
        out: dict[tuple, int] = {}
        for n, part in zip(names, parts, strict=True):
            out |= down(under[n], depth + 1, part)
        return out

    return down(sorted(caps), 0, total) if caps else {}


def seeded(seed: int, id_col: str, text_col: str) -> Column:
    """The hash of a row, of which each epoch's order is made."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.coalesce(F.col(text_col), F.lit(""))).cast("binary"))


def place(h: Column, whole: Column) -> Column:
    """A row's place in the epoch behind ``whole`` whole ones, 32 digits."""
    return F.md5(F.concat_ws(":", h, whole.cast("string")).cast("binary"))


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """The production rule: a source's number modulo 4; sources without a number are a domain of their own."""
    number = F.regexp_extract(source, "([0-9]{1,18})$", 1)
    return F.when(number == "", F.lit("other")).otherwise(F.concat(F.lit("d"), F.pmod(number.try_cast("long"), F.lit(4)).cast("string")))


def mix(docs: DataFrame, path: list[Column], weights: list[dict], budget: int | float, max_epochs: int = 1, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> tuple[DataFrame, dict]:
    """docs with columns for its leaf, tokens and ``epoch``, a row for each epoch that takes the document; and the leaves' budgets.

    budget: tokens, or as a float a share of all tokens. Tokens are those of the tokenizer file at ``tokenizer``, counted by
    ``bpe.count_tokens``, and the rows then have no column for them; without one they are words. A null name is the empty name; a null or empty text
    has no tokens and is in every prefix of its leaf that reaches its place. Repeated rows have the same place in the order and
    are taken together. A leaf without tokens takes whole epochs. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    levels = [f"level{k}" for k in range(len(path))]
    h = seeded(seed, id_col, text_col)
    names_of = [F.coalesce(p.cast("string"), F.lit("")).alias(n) for p, n in zip(path, levels, strict=True)]
    if tokenizer is None:
        keys = docs.select(*names_of, words(F.col(text_col)).alias("tokens"), h.alias("h"))
    else:
        # counts come back by a hash of the row and its length: rows alike in both are the same text, or the larger count stands for both
        row, size = F.xxhash64(h, F.lit("row")), F.coalesce(F.octet_length(F.col(text_col).cast("binary")), F.lit(0)).cast("long")
        asked = docs.select(row.alias("row"), F.col(text_col).alias("text"))
        counts = scratch.save(count_tokens(asked, tokenizer, id_col="row", text_col="text").groupBy(F.col("doc_id").alias("row"), F.col("n_bytes").alias("size")).agg(F.max("n_tokens").alias("tokens")), "counts")
        keys = docs.select(*names_of, h.alias("h"), row.alias("row"), size.alias("size")).join(counts, ["row", "size"]).select(*levels, "tokens", "h")
    keys = scratch.save(keys, "keys")
    sums = keys.groupBy(*levels).agg(F.sum("tokens").alias("tokens")).limit(MOST_LEAVES + 1).collect()
    if len(sums) > MOST_LEAVES:
        raise ValueError(f"over {MOST_LEAVES} leaves: group sources first")
    leaves = {tuple(r[n] for n in levels): r["tokens"] for r in sums}
    total = budget if isinstance(budget, int) else int(Fraction(budget).limit_denominator(10**6) * sum(leaves.values()))
    wanted = budgets(leaves, total, weights, max_epochs)
    plan = []
    for p, n in leaves.items():
        whole, rest = (max_epochs, 0) if not n else divmod(wanted[p], n)
        plan.append((*p, whole, rest, wanted[p]))
    schema = ", ".join(f"{n} string" for n in levels) + ", whole int, rest long, leaf_budget long"
    plan = scratch.save(docs.sparkSession.createDataFrame(plan, schema), "plan")
    # the order of the epoch that is cut: another order for another number of whole epochs
    open_ = keys.join(F.broadcast(plan.where("rest > 0")), levels).select(*levels, "tokens", "rest", place(F.col("h"), F.col("whole")).alias("place"))
    # the slice so far: the first digits of its places, and the tokens before it
    edge = plan.where("rest > 0").select(*levels, F.lit("").alias("slice"), F.lit(0).cast("long").alias("before"))
    digits = 0
    for step in STEPS:
        held = open_.withColumn("slice", F.substring("place", 1, digits)).join(F.broadcast(edge), [*levels, "slice"])
        digits += step
        sums = held.groupBy(*levels, F.substring("place", 1, digits).alias("slice")).agg(F.sum("tokens").alias("tokens"), F.max("rest").alias("rest"), F.max("before").alias("before"))
        upto = F.col("before") + F.sum("tokens").over(W.partitionBy(*levels).orderBy("slice"))
        over = sums.withColumn("upto", upto).where("upto > rest").groupBy(*levels).agg(F.min_by(F.struct("slice", (F.col("upto") - F.col("tokens")).alias("before")), "slice").alias("edge"))
        edge = scratch.save(over.select(*levels, "edge.slice", "edge.before"), f"edge{digits}")
    within = open_.withColumn("slice", F.substring("place", 1, digits)).join(F.broadcast(edge), [*levels, "slice"])
    upto = F.col("before") + F.sum("tokens").over(W.partitionBy(*levels).orderBy("place"))
    fits = within.withColumn("upto", upto).where("upto <= rest").groupBy(*levels).agg(F.max("place").alias("place"))
    # the last place that fits; if none of the slice does, all before the slice (a slice sorts before its own places)
    cuts = plan.join(F.broadcast(edge.join(F.broadcast(fits), levels, "left").select(*levels, F.coalesce("place", "slice").alias("cut"))), levels, "left")
    cuts = scratch.save(cuts, "cuts")
    names = {n: fresh(docs, n) for n in (*levels, "whole", "rest", "leaf_budget", "cut", "h", "epoch", "tokens")}
    cuts = cuts.select(*[F.col(c).alias(names[c]) for c in cuts.columns])
    made = {names[n]: F.coalesce(p.cast("string"), F.lit("")) for p, n in zip(path, levels, strict=True)} | {names["h"]: h}
    held = docs.withColumns(made | ({names["tokens"]: words(F.col(text_col))} if tokenizer is None else {}))
    met = held.join(F.broadcast(cuts), [names[n] for n in levels])
    mine = place(F.col(names["h"]), F.col(names["whole"]))
    more = (F.col(names["rest"]) > 0) & (F.col(names["cut"]).isNull() | (mine <= F.col(names["cut"])))
    epochs = F.col(names["whole"]) + more.cast("int")
    chosen = met.where(epochs > 0).withColumn(names["epoch"], F.explode(F.sequence(F.lit(1), epochs)))
    return chosen.select(*docs.columns, *[F.col(names[n]) for n in (*levels, *(["tokens"] if tokenizer is None else []), "epoch", "leaf_budget")]), wanted


def production_mix(docs: DataFrame, share_of_tokens: float = 0.5, max_epochs: int = 2, tokenizer: str | None = None) -> DataFrame:
    path = [domain_of(F.col("source")), F.col("lang"), F.col("source")]
    return mix(docs, path, [DOMAINS, LANGS, {}], share_of_tokens, max_epochs, tokenizer=tokenizer)[0]


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    got = production_mix(docs)
    return got.select("doc_id", F.col("level0").alias("domain"), F.col("level1").alias("lang"), F.col("level2").alias("source"), F.col("tokens").alias("n_tokens"), F.col("epoch"), "leaf_budget")


def _level_sql(name: str, parent: list[str], own: str, weight: str) -> str:
    """CTEs that share each parent's budget among its children: {name}(parent, own, cap, budget)."""
    by = ", ".join(parent) or "1"
    keys = ", ".join([*parent, own])
    join = f"JOIN {name}_of USING ({', '.join(parent)})" if parent else f", {name}_of"
    return f"""
{name}_in AS (SELECT {keys}, sum(cap)::BIGINT AS cap, {weight} AS w FROM leaf GROUP BY {keys}),
{name}_all AS (SELECT c.*, least(total, sum(cap) OVER (PARTITION BY {by}))::DOUBLE AS b, row_number() OVER (PARTITION BY {by} ORDER BY {own}) AS k FROM {name}_in c {join}),
{name}_cut AS (SELECT *, b - coalesce(sum(cap) OVER (PARTITION BY {by} ORDER BY cap::DOUBLE / w, {own} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_,
    sum(w) OVER (PARTITION BY {by} ORDER BY cap::DOUBLE / w, {own} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_ FROM {name}_all),
{name}_fit AS (SELECT *, cap * open_ <= left_ * w AS full_ FROM {name}_cut),
{name}_got AS (SELECT *, CASE WHEN full_ THEN cap::DOUBLE ELSE w * (max(left_ / open_) FILTER (WHERE NOT full_) OVER (PARTITION BY {by})) END AS got FROM {name}_fit),
{name}_low AS (SELECT *, floor(got + 1e-9)::BIGINT AS whole_ FROM {name}_got),
{name} AS (SELECT {keys}, cap, whole_ + CASE WHEN row_number() OVER (PARTITION BY {by} ORDER BY round(whole_ - got, 9), k) <= round(b - sum(whole_) OVER (PARTITION BY {by})) THEN 1 ELSE 0 END AS budget FROM {name}_low)"""


OP5_SQL = f"""
WITH t AS (SELECT doc_id, 'd' || (regexp_extract(source, '([0-9]{{1,18}})$', 1)::BIGINT % 4) AS domain, lang, source,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens, md5('20|' || doc_id || '|' || text) AS h FROM documents),
leaf AS (SELECT domain, lang, source, 2 * sum(n_tokens)::BIGINT AS cap FROM t GROUP BY ALL),
top_of AS (SELECT sum(n_tokens)::BIGINT // 2 AS total FROM t),{_level_sql("top", [], "domain", "CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END")},
mid_of AS (SELECT domain, budget AS total FROM top),{_level_sql("mid", ["domain"], "lang", "CASE WHEN lang = 'en' THEN 4 WHEN lang IN ('de', 'fr', 'es') THEN 2 ELSE 1 END")},
low_of AS (SELECT domain, lang, budget AS total FROM mid),{_level_sql("low", ["domain", "lang"], "source", "1")},
plan AS (SELECT domain, lang, source, budget, CASE WHEN cap = 0 THEN 2 ELSE budget // (cap // 2) END AS whole, CASE WHEN cap = 0 THEN 0 ELSE budget % (cap // 2) END AS rest FROM low),
o AS (SELECT t.*, whole, rest, budget, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5(h || ':' || whole)) AS upto FROM t JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, unnest(range(1, whole + 1 + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END))::INTEGER AS epoch, budget AS leaf_budget FROM o
"""
