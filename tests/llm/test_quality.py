import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlead.llm import quality, segments


def test_segments_unwrap_and_itemize():
    wrapped = "It has been found that graphite with 131 percent\nfiller lasts longer than silicone alone, which is\nwhy the user may replace the worn valve seat of the\nfirst pump."
    assert len(segments.segments(wrapped)) == 1
    assert segments.segments("> quoted line that is as long as the others here\n> and goes on in the next line of the same text\n> end")[0].startswith("quoted line")
    assert segments.segments("a\n\nb\n  \n c ") == ["a", "b", "c"]
    assert len(segments.segments("the wear pad from Vessaly / cork or nylon / 12 of the pumps / rigid hinge pin / a lens barrel")) == 5
    assert segments.segments(" \n\t\n") == [] and segments.segments("") == []


def test_statistics_do_not_depend_on_the_batch():
    texts = ["One sentence is here. Another, with a comma.", "- item\n- item two", "", "x | y | z", "𝒳 \U0001f600 ok", "a" * 50_000]
    counts = [(int(h), int(n), int(i)) for h, n, i in zip(*segments.word_counts(texts))]
    who, chars, x = segments.statistics(texts, segments.Lexicon.of({"is", "a"}, counts))
    for i, t in enumerate(texts):
        _, c, own = segments.statistics([t], segments.Lexicon.of({"is", "a"}, counts))
        assert np.allclose(x[who == i], own) and np.allclose(chars[who == i], c)
    assert x.shape[1] == len(segments.NAMES) and np.isfinite(x).all()
    at = segments.NAMES.index("common_share")
    assert x[0, at] == 2 / 8 and x[1, segments.NAMES.index("has_marker")] == 1.0


def corpus(spark, copies=30):
    prose = ["The pump is placed between the filter and the valve, so that no part is lost when it opens. It has been found that cork lasts longer than nylon.", "nothing was changed in this release because the notes were read by two people who had not agreed before"]
    lists = ["- red pump\n- blue valve\n- green pad\n- nylon\n- cork seal", "1. wheel hub\n2. wear pad\n3. lens barrel\n4. guide rail"]
    tables = ["| year | share |\n| --- | --- |\n| 1990 | 0.25 |\n| 1991 | 0.31 |\n| 1992 | 0.11 |", "1990;0.25;7\n1991;0.31;8\n1992;0.11;9\n1993;0.15;2"]
    junk = ["#~^|;' ,.|^~ #~^|\n~~^^|| ;;'' ..\n========\n_____", "e50113 ERR q=368213;st=NaN\na54866 ERR idx=291876;rc=null\nb09295 ERR ptr=695746"]
    rows, labels = [], []
    for kind, pool in zip(quality.KINDS, (prose, lists, tables, junk)):
        for i in range(copies):
            rows.append((len(rows), f"{pool[i % 2]}\n{pool[(i + 1) % 2]}" if i % 3 else pool[i % 2].upper()))
            if i < 10:
                labels.append((len(rows) - 1, f" {kind.upper()} " if i == 3 else kind, "r"))
    docs = spark.createDataFrame([*rows, (9001, None), (9002, " \n "), (9003, prose[0]), (9003, prose[0])], "doc_id bigint, text string")
    return docs, spark.createDataFrame([*labels, (0, "prose", "r"), (0, "list", "r"), (None, "list", "r"), (1, "other", "r")], "doc_id bigint, label string, labelled_by string")


COMMON = [("en", w) for w in "the of and is that it was so no for by be two".split()]


def test_kinds_are_told_apart(spark):
    docs, labels = corpus(spark)
    out = {r["doc_id"]: r for r in quality.document_kinds(docs, labels, spark.createDataFrame(COMMON, "lang string, word string"), components=8).collect()}
    assert 9001 not in out and 9002 not in out and out[9003]["kind"] == "prose" and len(out) == 121
    right = sum(out[i]["kind"] == quality.KINDS[i // 30] for i in range(120))
    assert right >= 117
    for r in out.values():
        assert abs(sum(r[f"{k}_share"] for k in quality.KINDS) - 1) < 1e-6


def test_without_labels_or_documents(spark):
    docs, labels = corpus(spark, 4)
    common = spark.createDataFrame(COMMON, "lang string, word string")
    assert quality.document_kinds(docs, labels.where("false"), common).count() == 0
    assert quality.document_kinds(docs, labels.where("label = 'prose'"), common).count() == 0
    assert quality.document_kinds(docs.where("false"), labels, common).count() == 0
    assert quality.document_kinds(docs, labels, common.where("false"), components=4).count() > 0


def test_mixture_finds_planted_components(spark):
    random = np.random.default_rng(1)
    d = len(segments.NAMES)
    a, b = random.normal(0, 1, (900, d)), random.normal(6, 2, (300, d))
    rows = [(i, np.ones(1, np.float32).tobytes(), x.astype(np.float32).tobytes()) for i, x in enumerate(np.vstack([a, b]))]
    table = spark.createDataFrame(rows, "doc_id bigint, chars binary, x binary").repartition(4)
    model = quality.fit_mixture(table, components=2, start_segments=200)
    assert model.converged
    mean = model.mean * model.scale + model.centre
    assert np.allclose(sorted(model.weight), [0.25, 0.75], atol=0.02)
    low, high = sorted(mean, key=lambda m: m.sum())
    assert np.abs(low).max() < 0.5 and np.abs(high - 6).max() < 0.7
    with pytest.warns(RuntimeWarning, match="still moves after 1 rounds"):
        assert not quality.fit_mixture(table, components=2, rounds=1).converged


def test_components_are_named_by_inspected_documents():
    shares = np.array([[0.9, 0.1, 0.0, 0.0], [0.8, 0.2, 0.0, 0.0], [0.9, 0.1, 0.0, 0.0], [0.3, 0.7, 0.0, 0.0], [0.1, 0.1, 0.8, 0.0]])
    named = quality.name_components(shares, np.array([0, 0, 0, 1, 2]), 4)
    assert named.argmax(1).tolist() == [0, 1, 2, 3] and (named.sum(1) == 1).all()
    # the second component stands in prose and in most lists, which come out right only if it is list
    mixed = np.array([[0.7, 0.3, 0.0]] * 6 + [[0.0, 0.6, 0.4]] * 3 + [[0.0, 0.9, 0.1]] * 3)
    assert quality.name_components(mixed, np.array([0] * 6 + [1] * 6), 2).argmax(1).tolist() == [0, 1, 1]


def test_document_statistics(spark):
    docs = spark.createDataFrame([(1, "The cat is here.\nYes\n\n- no!"), (2, None), (3, " "), (1, "The cat is here.\nYes\n\n- no!")], "doc_id bigint, text string").withColumn("w", F.lit(0))
    out = quality.document_statistics(docs, spark.createDataFrame(COMMON, "lang string, word string")).orderBy("doc_id").collect()
    assert len(out) == 4
    r = out[0]
    assert (r["n_words"], r["n_lines"]) == (6, 3) and r["mean_word_length"] == 17 / 6 and r["common_word_share"] == 3 / 6 and r["punctuated_line_share"] == 2 / 3
    assert (out[2]["n_words"], out[2]["mean_word_length"], out[2]["symbol_ratio"]) == (0, None, None)


def test_common_words_in_several_sets(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "the pump and the valve of nylon")], "doc_id bigint, text string")
    common = spark.createDataFrame([("en", w) for w in ("The", "and", "of", "cork")] + [("en", None)], "lang string, word string")
    whole = quality.document_statistics(docs, common).collect()
    monkeypatch.setattr(quality, "WORD_BLOCK", 1)
    assert quality.document_statistics(docs, common).collect() == whole and whole[0]["common_word_share"] == 4 / 7


def test_words_of_sentences_are_learned_from_all_texts(spark):
    docs = spark.createDataFrame([(1, "it was lost. it was found."), (2, "- red pump\n- lost pad"), (3, None), (4, ""), (5, "It is")], "doc_id bigint, text string")
    got = {r[0]: r[1:] for r in quality.frequent_words(docs.repartition(3))}
    def seen(word):
        return got[segments._word_hash(word) - (1 << 64 if segments._word_hash(word) >= 1 << 63 else 0)]

    assert seen("it") == (3, 2) and seen("was") == (2, 2) and seen("lost") == (2, 1) and seen("pump") == (1, 0) and len(got) == 8
    assert quality.frequent_words(docs.where("false")) == []
