from __future__ import annotations

import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from cadenza.llm import components, ngram_join, quality_model, queries, storage, toxicity, training, vector_search
from cadenza.llm.storage import cut, made, release
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .conftest import words
from .test_text_operators import brute_classes, covered

SF = "/root/testdata/sf0.001"


def fold(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


@pytest.fixture(scope="module")
def labelled(spark):
    """Clean prose, insults and broken texts under made-up labels."""
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    docs, labels = [], []
    for i in range(1200):
        ws = [word() for _ in range(r.randint(12, 60))]
        toxic, broken = i % 6 == 0, i % 5 == 0
        if toxic:
            ws[r.randrange(len(ws))] = r.choice(["vermin", "halfwit"])
        if broken:
            ws = [w + r.choice(["%%%", "###", "&&&"]) for w in ws]
        docs.append((i, " ".join(ws).capitalize() + ".", "x"))
        labels.append((i, int(not broken), int(toxic)))
    docs += [(5000, None, "x"), (5001, "", "x"), (None, "a text without an id", "x"), docs[3]]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {d: (q, t) for d, q, t in labels}


def accuracy(rows, truth, at):
    held = [(r.predicted, truth[r.doc_id][at]) for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 100
    return sum(p == y for p, y in held) / len(held)


def test_toxicity(spark, labelled):
    docs, labels, truth = labelled
    got = toxicity.digest(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (fold(r.doc_id, 4) == 2) for r in got if r.doc_id is not None)
    assert accuracy(got, truth, 1) > 0.98
    full = toxicity.toxicity(docs, labels)
    assert "evidence" in full.columns and full.schema["score"].dataType.simpleString() == "double"
    assert toxicity.digest(docs.limit(0), labels).count() == 0
    assert {r.predicted for r in toxicity.digest(docs, labels.limit(0)).collect()} == {0}


def test_labels_of_the_held_out_fold_are_not_used(spark, labelled):
    docs, labels, _ = labelled
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    key = lambda df: sorted((str(r.doc_id), r.score) for r in df.collect())
    assert key(toxicity.digest(docs, labels)) == key(toxicity.digest(docs, flipped))


def test_grammar_headings():
    g = toxicity.Grammar({"idiot": 3.0, "idiot$": 3.0, "vil": 2.0})
    heading = lambda t: dict(zip(toxicity.HEADINGS, g.evidence(t).tolist(), strict=True))
    assert heading("what an idiot.") == {"plain": 3.0, "aimed": 0.0, "denied": 0.0, "reported": 0.0}
    assert heading("you idiot!")["aimed"] == 3.0
    assert heading("they are not an idiot.")["denied"] == 3.0
    assert heading("she said idiot. villain")["reported"] == 3.0 and heading("she said idiot. villain")["plain"] == 2.0
    assert sum(heading("a fine day. vil").values()) == 0.0  # the beginning alone is another word
    assert heading("I will kill you")["aimed"] == toxicity.THREAT_WEIGHT
    assert sum(heading(None).values()) == sum(heading("").values()) == 0.0


STEPS = (toxicity.INSULT, toxicity.THREAT, toxicity.NEGATION, toxicity.REPORT, toxicity.TARGET)


def brute_outputs(symbols, steps):
    """Every way through the transducers one after the other: emitted symbols and weights."""
    now = [[(s, 1.0) for s in symbols]]
    for step in steps:
        now = [[(out, w * before[i][1]) for i, (out, w) in enumerate(path)] for before in now for path in step.paths([s for s, _ in before])]
    return now


def test_composition_equals_the_transducers_one_by_one():
    r = random.Random(2)
    names = ("insult", "threat", "target", "negation", "report", "other")
    for _ in range(400):
        clause = [r.choice(names) for _ in range(r.randint(0, 9))]
        paths = brute_outputs(clause, STEPS)
        assert len(paths) == 1 and toxicity.GRAMMAR.paths(clause) == paths
        weights = [r.random() for _ in clause]
        wanted = [sum(w * v for (out, w), v in zip(paths[0], weights, strict=True) if out == h) for h in toxicity.HEADINGS]
        assert np.allclose(toxicity.clause_evidence(list(zip(clause, weights, strict=True))), wanted)


def test_every_transducer_counts():
    clauses = (["insult", "other", "insult"], ["threat", "other", "target"], ["negation", "other", "insult"], ["report", "insult"], ["insult", "target"])
    for left_out, clause in enumerate(clauses):
        rest = [s for i, s in enumerate(STEPS) if i != left_out]
        assert brute_outputs(clause, rest) != brute_outputs(clause, STEPS), left_out


def test_stems_that_count_by_two_words(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7)))
    rows = []
    for i in range(600):
        ws = [word() for _ in range(30)]
        for at in range(3 if i % 6 == 0 else i % 3 == 0):
            ws[at * 7] = "zorq" + word()
        rows.append((" ".join(ws), int(i % 6 == 0)))
    stems = toxicity.learn_stems(spark.createDataFrame(rows, "text string, y int"))
    g = toxicity.Grammar(stems)
    assert any(s.startswith("zor") for s in stems)
    assert g.evidence("zorqab is zorqcd").sum() > 1.5 * g.evidence("zorqab alone").sum() > 0


def test_risk_gradient():
    """The gradients of both terms of the risk against finite differences."""
    rng = np.random.default_rng(0)
    xp, xu = rng.normal(1, 1, (40, 5)), rng.normal(0, 1, (60, 5))
    w = quality_model._start(5, rng)
    _, _, plus, minus = quality_model.risk(w, xp, xu, 0.7)
    for i in rng.permutation(len(w))[:40]:
        step = np.zeros(len(w))
        step[i] = 1e-6
        up, down = quality_model.risk(w + step, xp, xu, 0.7), quality_model.risk(w - step, xp, xu, 0.7)
        assert abs((up[0] - down[0]) / 2e-6 - plus[i]) < 1e-5 and abs((up[1] - down[1]) / 2e-6 - minus[i]) < 1e-5


def test_class_prior_from_positive_and_unlabelled_rows():
    rng = np.random.default_rng(1)
    for prior in (0.3, 0.6, 0.85):
        positive = rng.normal(1.5, 1, (3000, 4))
        n = int(5000 * prior)
        unlabelled = np.concatenate([rng.normal(1.5, 1, (n, 4)), rng.normal(-1.5, 1, (5000 - n, 4))])
        assert abs(quality_model.class_prior(positive, unlabelled) - prior) < 0.05


def test_training_rows_are_bounded(spark):
    """An id that many rows share doesn't multiply the rows a model is fitted on."""
    docs = spark.createDataFrame([(i % 3, f"text {i}") for i in range(500)] + [(1, "same")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(3)], "doc_id long, quality int, toxic int")
    assert training.training_rows(docs, labels, "quality", 3, 1, 40).count() <= 40
    assert training.training_rows(docs.filter("text = 'same'"), labels, "quality", 4, 3, 40).count() <= 1


def test_models_read_very_long_texts_and_clashing_names(spark, labelled, messy):
    docs, labels, _ = labelled
    long = spark.createDataFrame([(9000, "abc def. " * 60_000 + "you vermin"), (9001, "x" * 1_000_000)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(long)
    got = {r.doc_id: r for r in toxicity.digest(both, labels).filter("doc_id >= 9000").collect()}
    assert got[9000].predicted == 1 and got[9001].predicted == 0
    assert quality_model.digest(both, labels).filter("doc_id >= 9000").count() == 2
    for df in (toxicity.toxicity(messy, labels), quality_model.quality_model(messy, labels)):
        assert df.count() == messy.count() and [c for c in df.columns if c.lower() == "score"] == ["score"]


def test_quality_model(spark, labelled):
    docs, labels, truth = labelled
    got = quality_model.digest(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (fold(r.doc_id, 3) == 1) for r in got if r.doc_id is not None)
    assert accuracy(got, truth, 0) > 0.97
    assert quality_model.digest(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality_model.digest(docs, labels.limit(0)).collect()} == {1.0}


def test_quality_model_sees_every_row(spark, monkeypatch):
    """Centre and spread come from all rows; the unlabelled sample follows rows, also where one id holds many of them."""
    r = random.Random(4)
    text = lambda mark: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) + mark for _ in range(r.randint(12, 40)))
    rows = [(i, text("")) for i in range(1500)] + [(7, text("%")) for _ in range(500)] + [(None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    seen = {}
    monkeypatch.setattr(quality_model, "fit", lambda positive, unlabelled, *rest: seen.update(u=unlabelled, rest=rest))
    quality_model.learn(docs, labels, sample=400)
    x = quality_model.describe([t for _, t in rows])
    middle, spread = seen["rest"]
    assert np.abs(middle - np.median(x, 0)).max() < 2e-3 and np.abs(spread - x.std(0)).max() < 2e-4
    assert len(seen["u"]) == 400 and 0.15 < (seen["u"][:, 0] > 0).mean() < 0.35  # 500 of 2002 rows


def exact(ids, x, every, k):
    out = {}
    for q, v in zip(ids, x, strict=True):
        if q % every == 0:
            s = x @ v
            order = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-round(s[i], 9), ids[i]))
            out[q] = [ids[i] for i in order[:k]]
    return out


def test_vector_search(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[500:1500] = x[500]  # a third of all vectors is one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [1.0]), (9005, [float("inf")] + [0.0] * 15), (None, [1.0] * 16), (9006, [None] + [1.0] * 15), (9020, [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = vector_search.search(df, lists=32).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    truth = exact(list(range(3000)), x.astype(np.float64), 20, 20)
    assert set(found) == set(truth) and all(len(v) == 20 for v in found.values())
    assert sum(len({i for i, _ in found[q]} & set(truth[q])) for q in truth) / (20 * len(truth)) >= 0.9
    assert [i for i, _ in found[600]] == truth[600]  # ties go to the smaller ids
    assert all(abs(s - float(x[q].astype(float) @ x[i].astype(float))) < 1e-9 for q in list(found)[:20] for i, s in found[q])
    assert vector_search.search(df.limit(0)).count() == 0
    few = vector_search.search(df.filter("vec_id < 5"), visited=1.0).collect()
    assert sorted((r.rank, r.vec_id) for r in few) == sorted(enumerate(exact(range(5), x[:5].astype(float), 20, 20)[0], 1))


def test_vector_search_fills_up_the_answer(spark):
    """Every query has 20 rows, or all candidates, in few vectors, in a skewed table and where an id is repeated; all by the default parameters."""
    rng = np.random.default_rng(2)
    tables = {n: list(enumerate(rng.normal(size=(n, 8)))) for n in (16, 24, 32, 45, 60)}
    rare = rng.normal(size=(31, 8))
    tables["skew"] = [(i + 1000 if i else 0, rare[0]) for i in range(4000)] + [(20 * i, v) for i, v in enumerate(rare[1:], 1)]
    tables["repeated"] = [(0, v) for v in rng.normal(size=(30, 8))] + list(enumerate(rng.normal(size=(12, 8)), 1))
    for name, rows in tables.items():
        df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
        got = vector_search.search(df).select("query_id", "vec_id").collect()
        ids = [i for i, _ in rows]
        for q in {i for i in ids if i % 20 == 0}:
            found = [r.vec_id for r in got if r.query_id == q]
            # each vector of a repeated id asks for itself, and the others are candidates
            assert len(found) == ids.count(q) * min(20, len(ids) - 1), (name, q)
            assert ids.count(q) > 1 or q not in found, (name, q)


def test_repeated_query_rows_ask_once(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(401, 16))
    rows = [(i, v.tolist(), "a") for i, v in enumerate(x)] + [(20, x[20].tolist(), "b")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, RANK string").withColumn("score", F.lit(1))
    got = [r.vec_id for r in sorted(vector_search.search(df, visited=1.0, refine=None).filter("query_id = 20").collect(), key=lambda r: r["rank"])]
    order = sorted((i for i in range(401) if i != 20), key=lambda i: (-(x[i] @ x[20]), i))
    assert got == [20, *order[:19]]  # the copy is a candidate, and the nearest


def test_vector_search_is_exact_when_all_is_visited(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 12))
    x[300:400] = x[300]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = vector_search.search(df, visited=1.0, refine=None, part=64).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert found == exact(list(range(700)), x, 20, 20)


def test_vector_search_recall_of_the_registered_query(spark):
    sf = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    truth = exact(table.vec_id.tolist(), np.array(table.embedding.tolist(), float), 20, 20)
    got = queries.queries()["op9_vector_search"](spark, sf).toPandas()
    hits = sum(len(set(truth[q]) & set(part)) for q, part in got.groupby("query_id")["vec_id"])
    assert len(got) == 20 * len(truth) and hits >= 0.9 * len(got)


def test_vector_search_recall_where_queries_lie_close_together(spark):
    """The queries are a small share of the rows and differ by less than the codebooks tell; with fixed numbers of lists and measured rows recall was 0.75."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(12000, 32))
    x[::20] = x[0] + 0.001 * rng.normal(size=(600, 32))
    got = vector_search.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).toPandas()
    truth = exact(list(range(len(x))), x, 20, 20)
    hits = sum(len(set(truth[q]) & set(part)) for q, part in got.groupby("query_id")["vec_id"])
    assert len(got) == 20 * len(truth) and hits >= 0.97 * len(got)


def test_vector_search_of_a_hot_list_over_many_parts(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(900, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:400] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = [r.vec_id for r in sorted(vector_search.search(df, part=50).filter("query_id = 40").collect(), key=lambda r: r["rank"])]
    assert got == [i for i in range(21) if i != 40][:20]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(200, 300), (300, 201), (5, 5), (900, 400)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 61)} == {1} and got[201] == got[300] == 200 and got[900] == 400


def test_forest_depth():
    assert ngram_join.forest_depth(0.8, 16, 0.9995, 12) == 4
    assert ngram_join.forest_depth(ngram_join.THRESHOLD, ngram_join.TREES, ngram_join.RECALL, ngram_join.DEEPEST) == 4
    with pytest.raises(ValueError):
        ngram_join.forest_depth(0.1, 1, 0.9999, 4)


@pytest.fixture(scope="module")
def small_corpus(spark, tmp_path_factory):
    """Messy documents of every kind that the stages look for, with labels, as files."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    shared, passage = "This is a line that a good many documents of the table share.", prose(60)
    docs, labels = [], []
    for i in range(500):
        text, broken = prose(r.randint(20, 90)), i % 5 == 0
        if i % 7 == 1:
            text += "\n" + shared + "\n" + prose(12)
        if i % 11 == 2:
            text = prose(20) + " " + passage + " " + prose(20)
        if broken:
            text = " ".join(w + r.choice(["%%%", "###", "&&&"]) for w in text.split(" "))
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(not broken), 0))
    base = prose(150).split(" ")
    for i in range(500, 520):
        near = list(base)
        near[r.randrange(150)] = "changed"
        docs.append((i, " ".join(near), "en", "s", 1))
    docs += [(600, docs[3][1], None, None, None), docs[4], docs[4], (None, docs[6][1], "en", "s", 1), (None, None, None, None, None), (601, None, "en", "s", 0), (602, "", "en", "s", 0), (603, prose(9000), "en", "s", 1)]
    sf = str(tmp_path_factory.mktemp("corpus"))
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").withColumn("TEXT2", F.lit("x"))
    table.repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    return sf


def brute_near(rows):
    wanted = brute_classes([(i, t) for i, t, *_ in rows])
    by_class = {}
    for row, (_, name, _) in zip(rows, wanted, strict=True):
        if words(row[1]):
            # the least id stays; of null ids and equal ids any row with that text
            key = (row[0] is None, row[0] or 0)
            by_class[name] = min(by_class.get(name, (key, row)), (key, row), key=lambda x: x[0])
    return [row for _, row in by_class.values()] + [row for row in rows if not words(row[1])]


def brute_lines(rows):
    holders = {}
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate({c: c + 32 for c in range(65, 91)})
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add((i, t))
    last = {k: max((i for i, _ in v if i is not None), default=None) for k, v in holders.items() if len(v) >= 5}
    out = []
    for i, t, lang, source, _ in rows:
        kept = "\n".join(x for x in (t or "").split("\n") if key(x) not in last or last[key(x)] == i)
        out.append((i, kept, lang, source, len(kept)))
    return out


def brute_substrings(rows):
    seen = Counter(tuple(w[k : k + 35]) for w in (words(t) for _, t, *_ in rows) for k in range(len(w) - 34))
    out = []
    for i, t, lang, source, _ in rows:
        w = words(t)
        gone = covered(w, lambda k: seen[k] > 1, 35)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, kept, lang, source, len(kept)))
    return out


def test_pipeline_against_brute_force(spark, small_corpus):
    docs = spark.read.parquet(f"{small_corpus}/documents.parquet")
    labels = spark.read.parquet(f"{small_corpus}/labels.parquet")
    rows = [tuple(r) for r in docs.select(corpus_pipeline.COLUMNS).collect()]
    model = quality_model.learn(docs, labels)
    good = model.score(quality_model.describe([r[1] for r in rows])) >= 0.5
    rows = [r for r, g in zip(rows, good, strict=True) if g]
    assert 380 < len(rows) < 440
    stages = dict(corpus_pipeline.STAGES)
    now = stages["quality"](spark, docs, small_corpus)
    assert Counter(map(tuple, now.collect())) == Counter(rows)
    for name, brute in (("lines", brute_lines), ("near", brute_near), ("substrings", brute_substrings)):
        before = len(rows), sum(len(r[1] or "") for r in rows)
        now, rows = cut(stages[name](spark, now, small_corpus)), brute(rows)
        assert now.columns == corpus_pipeline.COLUMNS
        assert Counter(r[:2] for r in map(tuple, now.collect())) == Counter(r[:2] for r in rows), name
        assert all(r.n_chars == len(r.text) for r in now.collect()) or name == "near"
        assert (len(rows), sum(len(r[1] or "") for r in rows)) != before, name
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = Counter()
    for i, t, *_ in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for a in range(0, len(ids), 2048):
            wanted[i, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes()), len(ids)] += 1
    before = len(made(spark))
    whole = corpus_pipeline.run(spark, small_corpus).collect()
    assert Counter(tuple(r)[:5] for r in whole) == wanted
    assert len(made(spark)) - before <= 2  # the last stage's input and pieces; the other tables are gone
    used = Counter()
    for r in whole:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048 and len(used) == -(-sum(used.values()) // 2048)
    release(spark)


def test_stages_of_empty_tables(spark, small_corpus):
    docs = spark.read.parquet(f"{small_corpus}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, small_corpus).count() == 0, name


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, SF))
        assert docs.columns == corpus_pipeline.COLUMNS, name
        counts.append(docs.count())
    assert counts[0] < 200 and counts[1] == counts[0] and counts[2] < counts[1] and counts[3] == counts[2]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    own = sorted(map(tuple, last.select("doc_id", "start", "length", "ids_crc32").collect()))
    whole = sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "start", "length", "ids_crc32").collect()))
    assert own == whole
    release(spark)


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Conf:
        def get(self, key, default):
            return default

    session = type("Session", (), {"conf": Conf(), "sparkContext": type("Context", (), {"master": "spark://host:7077", "applicationId": "a"})()})()
    with pytest.raises(RuntimeError):
        storage.shared_dir(session)


def test_every_contract_query_is_registered():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
