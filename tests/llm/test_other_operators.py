"""Classifier, chat repair, mixing, top-k and the pipeline against plain versions."""

import hashlib
import itertools
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.llm import brute
from tidewake.llm import chat, mixing, quality, topk


def ordered(got):
    return sorted((tuple(r) for r in got), key=repr)


# classifier


def test_held_out_accuracy(spark):
    """Fitted on half of the labelled documents, the other half's good ones stay and most others go."""
    base = DATA.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0
    got = quality.classify(docs.join(labels.where(~half), "doc_id", "left_semi").unionByName(docs.join(labels.where(half), "doc_id", "left_semi")), labels.where(half))
    held = got.join(labels.where(~half), "doc_id").withColumn("grade", quality.grade(F.col("quality"), F.col("toxic")))
    share = {r["grade"]: r["share"] for r in held.groupBy("grade").agg(F.avg(F.col("kept").cast("double")).alias("share")).collect()}
    assert share[2] > 0.98 and share[1] < 0.15 and share[0] < 0.25


def test_ordered_thresholds_and_probabilities():
    rng = np.random.default_rng(0)
    rows = [(np.array([k % 7, 7 + k % 3]), np.ones(2)) for k in range(300)]
    grades = np.array([min(2, int(3 * (k % 7) / 7 + rng.random() * 0.5)) for k in range(300)])
    model = quality.fit(rows, grades, 3, min_df=1, common=1.0)
    below = model.at_most(np.linspace(-5, 5, 11))
    assert model.thresholds[0] < model.thresholds[1] and (below[:, 0] <= below[:, 1]).all()
    score = np.array([model.weights[a] @ v for a, v in rows])
    assert np.corrcoef(score, grades)[0, 1] > 0.9


def test_gradient_is_that_of_the_likelihood():
    """At the fitted point the penalised likelihood falls in every direction."""
    rows = [(np.array([k % 3]), np.ones(1)) for k in range(60)]
    grades = np.array([(k % 3 + (k % 5 == 0)) % 3 for k in range(60)])
    model = quality.fit(rows, grades, 3, min_df=1, common=1.0, ridge=1e-2, steps=3000, rate=0.02)

    def loss(w, t):
        score = np.array([w[k % 3] for k in range(60)])
        p = quality.Ordinal(w, t).at_most(score)
        p = np.column_stack([np.zeros(60), p, np.ones(60)])
        return -np.log(p[np.arange(60), grades + 1] - p[np.arange(60), grades]).mean() + 0.5e-2 * (w**2).sum()

    w, t = model.weights[:3], model.thresholds
    for k, step in itertools.product(range(5), (-0.01, 0.01)):
        x = np.concatenate([w, t])
        x[k] += step
        assert loss(x[:3], x[3:]) > loss(w, t) - 1e-7


def test_classifier_on_awkward_rows(spark):
    docs = spark.createDataFrame(brute.awkward(2000), brute.SCHEMA)
    labels = spark.createDataFrame([(100 + k, k % 2, None) for k in range(14)] + [(None, 1, 0), (5, None, 1), (300, 1, 1), (300, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels)
    assert got.count() == docs.count() and got.where("p_top is null or p_top < 0 or p_top > 1").count() == 0
    none = labels.where("false")
    assert quality.classify(docs, none).where("kept").count() == docs.count()
    kept = quality.keep_good(docs, none)
    assert kept.columns == docs.columns and quality.keep_good(docs.where("false"), labels).count() == 0
    assert quality.classify(docs, labels).orderBy("doc_id", "p_top").collect() == got.orderBy("doc_id", "p_top").collect()


# chat


def cheapest(roles, costs):
    """The least cost by trying every way, state by state."""
    best = {chat.NONE: 0}
    for role in roles:
        new = {}
        for state, cost in best.items():
            for to in (chat.SYSTEM, chat.USER, chat.ASSISTANT):
                label = 0 if to == role else costs.relabel
                options = []
                if to == state:
                    options.append(costs.merge)
                if to == chat.SYSTEM:
                    options += [0] if state == chat.NONE else []
                elif to == chat.USER:
                    options.append(costs.insert if state == chat.USER else 0)
                else:
                    options.append(0 if state == chat.USER else costs.insert)
                for o in options:
                    new[to] = min(new.get(to, math.inf), cost + label + o)
        best = new
    tail = {chat.NONE: 0, chat.SYSTEM: 2, chat.USER: 1, chat.ASSISTANT: 0}
    return min(c + costs.insert * tail[s] for s, c in best.items())


def conversation_rows(seed=0):
    rng = random.Random(seed)
    out = []
    for c in range(60):
        for t in range(rng.randint(1, 7)):
            out.append((c, t, rng.choice(["user", "assistant", "system", "tool", None, "user", "assistant"]), rng.choice(["hi", "", None, "<|end|> x"])))
    out += [(None, 1, "user", "a"), (None, 2, "user", "b"), (70, None, "assistant", "x"), (70, 1, "user", "x"), (71, 1, "user", "r"), (71, 1, "user", "r"), (71, 1, "assistant", "r")]
    out += [(99, t, rng.choice(["user", "assistant", "tool"]), f"t{t}") for t in range(400)]  # spreads over parts
    return out


@pytest.mark.parametrize("seed", range(2))
def test_repairs_are_legal_and_cheapest(spark, seed):
    rows = conversation_rows(seed)
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, seg string")
    got = chat.repair(df).collect()
    assert len(got) == len(rows)
    costs, convs = chat.Costs(), {}
    for r in got:
        convs.setdefault(r["conv_id"], []).append(r)
    none_first = lambda v: (v is not None, v if v is not None else 0)
    for c, own in convs.items():
        own.sort(key=lambda r: r["turn_no"])
        assert [r["turn_no"] for r in own] == list(range(len(own)))
        given = sorted(((t, role, x) for i, t, role, x in rows if i == c), key=lambda r: (none_first(r[0]), (r[1] is not None, r[1] or ""), (r[2] is not None, r[2] or "")))
        assert [(r["turn"], r["role"]) for r in own] == [g[:2] for g in given]
        assert sum(r["cost"] for r in own) == cheapest([chat._code(g[1]) for g in given], costs)
        whole = "".join(r["rendered"] for r in own)
        spoken = [part.split("|>\n", 1)[0] for part in whole.split("<|")[1:] if not part.startswith("end|>")]
        assert spoken[-1] == "assistant" and whole.count("<|end|>") == len(spoken)
        chain = spoken[1:] if spoken[0] == "system" else spoken
        assert chain == ["user", "assistant"] * (len(chain) // 2)


def test_one_part_or_many_give_the_same(spark):
    df = spark.createDataFrame(conversation_rows(5), "conv_id long, turn long, role string, text string")
    many = ordered(chat.repair(df).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert ordered(chat.repair(df).collect()) == many
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert chat.repair(df.where("false")).collect() == []


def test_clean_conversations_stay(spark):
    got = chat.op4_chat_formatting(spark, DATA)
    assert got.where("role <> new_role").count() <= got.count() * 0.2
    clean = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a")], "conv_id long, turn long, role string, text string")
    assert [(r["action"], r["cost"]) for r in chat.repair(clean).orderBy("turn_no").collect()] == [("keep", 0)] * 3


# mixing


def test_shortages_go_to_siblings_first():
    leaves = {("a", "x"): 10, ("a", "y"): 1000, ("b", "z"): 1000}
    assert mixing.budgets(leaves, 400, [{}, {}], 1) == {("a", "x"): 10, ("a", "y"): 190, ("b", "z"): 200}
    assert mixing.budgets({("a", "x"): 10, ("a", "y"): 20, ("b", "z"): 1000}, 400, [{}, {}], 1) == {("a", "x"): 10, ("a", "y"): 20, ("b", "z"): 370}
    assert mixing.budgets({("a", "x"): 10, ("b", "z"): 5}, 400, [{}, {}], 2) == {("a", "x"): 20, ("b", "z"): 10}
    assert sum(mixing.share(100, [Fraction(1)] * 3, [90] * 3)) == 100 and mixing.share(100, [Fraction(0), Fraction(1)], [500, 30]) == [0, 30]


def plain_mix(rows, budget, max_epochs, seed=20):
    """Whole epochs, then the longest prefix in the order of the seeded places."""
    leaves = {}
    for r in rows:
        leaves.setdefault(tuple(r["path"]), []).append(r)
    wanted = mixing.budgets({p: sum(r["tokens"] for r in own) for p, own in leaves.items()}, budget, [mixing.DOMAINS, mixing.LANGS, {}], max_epochs)
    out = []
    for p, own in leaves.items():
        n = sum(r["tokens"] for r in own)
        whole, rest = (max_epochs, 0) if not n else divmod(wanted[p], n)
        for r in own:
            before = sum(o["tokens"] for o in own if o["place"][whole] <= r["place"][whole])
            out += [(r["doc_id"], r["tokens"], e) for e in range(1, whole + 1 + (rest > 0 and before <= rest))]
    return out


@pytest.mark.parametrize("max_epochs", [1, 3])
def test_mix_against_a_plain_version(spark, max_epochs):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").union(spark.read.parquet(f"{DATA}/documents.parquet").limit(3))
    extra = spark.createDataFrame([(None, "a b", None, None, 3), (900, None, "en", "src1", 0), (901, "", None, "odd", 0), (902, "x " * 9000, "xx", "odd", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(extra).withColumnRenamed("n_chars", "tokens")  # a name that clashes
    path = [mixing.domain_of(F.col("source")), F.col("lang"), F.col("source")]
    seen = docs.select("doc_id", F.array(*[F.coalesce(p, F.lit("")) for p in path]).alias("path"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    hashed = lambda s: hashlib.md5(s.encode()).hexdigest()
    rows = [r.asDict() | {"tokens": len(r["text"].encode().split()), "h": hashed(f"20|{'null' if r['doc_id'] is None else r['doc_id']}|{r['text']}")} for r in seen.collect()]
    rows = [r | {"place": [hashed(f"{r['h']}:{k}") for k in range(4)]} for r in rows]
    budget = sum(r["tokens"] for r in rows) * 2 // 3
    got, wanted = mixing.mix(docs, path, [mixing.DOMAINS, mixing.LANGS, {}], budget, max_epochs)
    names = got.columns
    assert names[: len(docs.columns)] == docs.columns
    mine = [(r[names.index("doc_id")], r[names.index("_tokens")], r[names.index("epoch")]) for r in got.collect()]
    assert ordered(mine) == ordered(plain_mix(rows, budget, max_epochs))
    assert sum(wanted.values()) == budget and mixing.production_mix(docs.where("false").drop("tokens")).count() == 0


# top-k


def best(rows, k=5, every=50):
    out = []
    seen = {(i, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    for i, q in seen:
        if i % every == 0:
            scores = {(-sum(a * b for a, b in zip(q, x, strict=True)), j) for j, x in seen if j != i and len(x) == len(q)}
            out += [(i, n, j, -s) for n, (s, j) in enumerate(sorted(scores)[:k], 1)]
    return out


def test_top_k_on_awkward_rows(spark):
    rng = random.Random(2)
    rows = [(k, [rng.gauss(0, 0.2) for _ in range(16)]) for k in range(240)]
    rows += [(300 + k, [0.25] * 16) for k in range(40)] + [(350, [0.25] * 16)] * 3  # ties and repeated rows, a query among them
    rows += [(400, None), (None, [0.1] * 16), (450, [float("nan")] * 16), (500, [None] * 16), (550, [float("inf")] * 16), (600, [0.5] * 3), (601, [0.1] * 3), (650, []), (651, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string").repartition(5)
    assert ordered(topk.top_k(df, F.col("vec_id") % 50 == 0).collect()) == ordered(best(rows))
    assert topk.top_k(df.where("false"), F.col("vec_id") % 50 == 0).collect() == []


def test_queries_in_several_blocks(spark, monkeypatch):
    """Batches of queries, chunks of rows and several groups: what a task holds is far less than the table."""
    monkeypatch.setattr(topk, "GROUP", 50)
    rng = random.Random(4)
    rows = [(k, [rng.gauss(0, 0.2) for _ in range(8)]) for k in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert ordered(topk.top_k(df, F.col("vec_id") % 10 == 0).collect()) == ordered(best(rows, every=10))


def test_bounds_are_bounds():
    rng = np.random.default_rng(0)
    a, b = rng.integers(-100, 100, (20, 64)), rng.integers(-100, 100, (30, 64))
    for s in topk.SEGMENTS:
        assert (topk.stats(a, s) @ topk.stats(b, s).T >= a @ b.T - 1e-6).all()


def test_components_too_large_for_a_score(spark):
    df = spark.createDataFrame([(k, [1e30, 1.0]) for k in (0, 50, 51)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(df, F.col("vec_id") % 50 == 0).collect()


# pipeline


def test_pipeline_against_its_plain_version(spark):
    import corpus_pipeline

    d = DATA.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = docs.columns
    good = corpus_pipeline.keep_quality(spark, docs, d)
    assert good.columns == names
    labels = spark.read.parquet(f"{d}/labels.parquet")
    clean = docs.join(labels.where("quality = 1 and toxic = 0"), "doc_id", "left_semi")
    assert clean.join(good.select("doc_id"), "doc_id", "left_anti").count() <= 0.02 * clean.count()
    single = corpus_pipeline.drop_exact_copies(spark, good, d)
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    assert single.columns == names and {r["doc_id"] for r in single.collect()} == {w[0] for w in brute.exact(rows) if w[3]}
    near = corpus_pipeline.drop_near_copies(spark, single, d)
    rows = [(r["doc_id"], r["text"]) for r in single.collect()]
    assert near.columns == names and {r["doc_id"] for r in near.collect()} == {c for _, _, c in brute.components(rows)}
    mixed = corpus_pipeline.mix_sources(spark, near, d)
    assert mixed.columns == names and mixed.select("doc_id").distinct().count() == mixed.count()
    assert {r["doc_id"] for r in corpus_pipeline.encode_bytes(spark, mixed, d).collect()} == {r["doc_id"] for r in mixed.collect()}
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
