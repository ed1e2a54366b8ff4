import corpus_fixture as C
import pytest

from ravelgrid.llm import language_id, quality

SF = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.identify(docs, language_id.fit_documents(docs)).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got) > 100
    assert all(0 <= r.score <= 1 for r in got)


def test_language_defined_cases(spark):
    df = C.frame(spark, clashing=True)
    model = language_id.fit_documents(df)
    got = {r.doc_id: r for r in language_id.identify(df, model).collect()}
    assert {got[i].lang_pred for i in (300, 301, 302, 308)} == {"und"}
    assert got[305].lang_pred == "en"
    nothing = language_id.fit_documents(C.frame(spark, []))
    assert nothing is None and language_id.identify(df, None).filter("lang_pred <> 'und'").isEmpty()
    assert language_id.identify(C.frame(spark, []), model).collect() == []
    assert language_id.family_of("pt-BR") == "romance" and language_id.family_of("tlh") == "tlh"


def test_language_learns_only_from_its_folds(spark):
    rows = [(i, "alpha beta gamma" if C.fold(i, 4) != 2 else "omega psi chi", "aa" if C.fold(i, 4) != 2 else "bb", "s", 5) for i in range(60)]
    df = C.frame(spark, rows)
    langs = {r.lang_pred for r in language_id.identify(df, language_id.fit_documents(df)).collect()}
    assert langs == {"aa"}


def test_quality_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_documents(docs, labels)
    got = quality.score_documents(docs, model).filter("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.93 * len(got) > 50


def test_quality_defined_cases(spark):
    df = C.frame(spark, clashing=True)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(100)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit_documents(df, labels)
    got = quality.score_documents(df, model).collect()
    assert len(got) == df.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert quality.fit_documents(df, labels.limit(0)) is None
    assert {r.score for r in quality.score_documents(df, None).collect()} == {0.5}
    kept = quality.keep_good(df, model)
    assert kept.columns == df.columns and kept.count() == sum(r.predicted for r in got)
    assert quality.score_documents(C.frame(spark, []), model).collect() == []


@pytest.mark.parametrize("text", [b"", b" ", b"x", b"a " * 5000, b"!" * 10000, "é漢".encode() * 100])
def test_passages_are_finite(text):
    import numpy as np

    x = quality.passages(text)
    assert x.shape[1] == quality.N_FEATURES and np.isfinite(x).all() and len(x) == max(1, -(-len(text.split()) // quality.PASSAGE_WORDS))


def test_many_languages_are_all_learnt(spark):
    """250 labels, far more than any plan literal would want; each has a word of its own."""
    import random

    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(250)]
    rows = [(i, f"{words[i % 250]} " * 12, f"q{i % 250:03d}", "s", 9) for i in range(1000)]
    df = C.frame(spark, rows)
    model = language_id.fit_documents(df, max_fit=500)
    assert len(model.families) == 250
    got = language_id.identify(df, model).join(df.select("doc_id", "lang"), "doc_id").collect()
    assert {r.lang_pred for r in got} == {f"q{i:03d}" for i in range(250)}
    assert sum(r.lang == r.lang_pred for r in got) > 0.98 * len(got)
    with pytest.raises(ValueError):
        language_id.fit_documents(df, max_labels=249)


def test_models_do_not_depend_on_partitions(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    again = docs.repartition(7, "text")
    a, b = language_id.fit_documents(docs), language_id.fit_documents(again)
    assert (a.family_w == b.family_w).all() and all((a.pair_w[k] == b.pair_w[k]).all() for k in a.pair_w)
    a, b = quality.fit_documents(docs, labels), quality.fit_documents(again, labels.repartition(5))
    assert all((a.p[k] == b.p[k]).all() for k in a.p)


def test_repeated_ids_have_one_text(spark):
    rows = [(i % 50, f"text {i} " * 30, "en", "s", 9) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    a = quality.fit_documents(C.frame(spark, rows), labels)
    b = quality.fit_documents(C.frame(spark, rows[::-1]).repartition(5), labels)
    assert all((a.p[k] == b.p[k]).all() for k in a.p)


def test_language_votes_equal_a_plain_count(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    model = language_id.fit_documents(docs)
    for r in language_id.identify(docs, model).join(docs.select("doc_id", "text"), "doc_id").collect():
        if r.lang_pred == "und":
            continue
        x = list(map(float, language_id.features(r.text.encode()))) + [1.0]
        margins = [sum(a * b for a, b in zip(w, x)) for w in model.family_w] if len(model.families) > 1 else [1.0]
        members = model.members[model.families[margins.index(max(margins))]]
        votes = dict.fromkeys(members, 0)
        for (a, b), w in model.pair_w.items():
            if a in votes:
                votes[a if sum(p * q for p, q in zip(w, x)) >= 0 else b] += 1
        assert votes[r.lang_pred] == max(votes.values())


def test_attention_equals_a_plain_forward_pass(spark):
    import math

    import numpy as np

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_documents(docs, labels)
    some = docs.limit(60)
    texts = {r.doc_id: r.text or "" for r in some.collect()}
    p = {k: v.astype(float) for k, v in model.p.items()}

    def sigmoid(v):
        return 1 / (1 + math.exp(-v))

    for r in quality.score_documents(some, model).collect():
        made = []
        for row in quality.passages(texts[r.doc_id].encode()).astype(float):
            h = np.tanh((row - model.mean) / model.scale @ p["E"] + p["e"])
            gate = [math.tanh(h @ p["V"][:, k]) * sigmoid(h @ p["U"][:, k]) for k in range(quality.GATE)]
            made.append((math.exp(sum(g * w for g, w in zip(gate, p["w"]))), h))
        total = sum(a for a, _ in made)
        pooled = sum(a / total * h for a, h in made)
        assert abs(sigmoid(float(pooled @ p["o"] + p["b"][0])) - r.score) < 1e-3
