import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tersa.llm import language, ngram_join, packing, secret_scan, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")}


def odd(spark, names="doc_id long, text string, lang string, source string, n_chars long"):
    rows = [(None, "the and of", "en", "s", 10), (3, None, None, "s", None), (4, "", "en", "s", 0),
            (5, "123 !!", "de", "s", 6), (6, "x" * 100_000, "fr", "s", 1), (6, "a b c", "fr", "s", 5)]
    return spark.createDataFrame(rows, names)


# --- language -------------------------------------------------------------------

def test_language_is_right_on_held_out_rows(spark, tables):
    rows = language.language_id(tables["documents"].withColumn("lang_pred", tables[
        "documents"].lang)).collect()
    truth = {r.doc_id: r.lang for r in tables["documents"].collect()}
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(spark):
    rows = language.language_id(odd(spark)).collect()
    assert len(rows) == 6
    assert sorted(r.lang_pred for r in rows if r.doc_id in (3, 4, 5)) == ["und"] * 3
    assert all(r.lang_pred in ("en", "fr", "de", "und") for r in rows)
    assert language.language_id(odd(spark).where("doc_id > 9")).count() == 0
    unknown = odd(spark).selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r.lang_pred for r in language.language_id(unknown).collect()} == {"und"}
    kept = language.keep_identified(odd(spark))
    assert kept.columns == odd(spark).columns and kept.where("text is null or text = ''").isEmpty()


def test_hierarchy():
    texts = {"en": "the house of the king", "de": "das haus der könige und", "fr": "la maison est le roi",
             "es": "la casa del rey y los", "xx": "qqq zzz kkk"}
    langs = sorted(texts) * 6
    counts = np.array([next(language._doc_features(pa.array([texts[v]]))) for v in langs])
    model = language.Model(counts, langs)
    assert model.tree == {"germanic": ["de", "en"], "romance": ["es", "fr"], "xx": ["xx"]}
    got, score = model.predict(pa.array([texts[v] for v in sorted(texts)] + ["", "12"]))
    assert got.tolist() == [*sorted(texts), "und", "und"] and (score[:5] > 0.5).all()


def test_unlearned_languages_and_gibberish_are_rejected(spark, tables):
    docs = tables["documents"].select("doc_id", "text", "lang")
    strange = [(-1, "Sää on tänään kylmä, ja lapset eivät halua lähteä kouluun ennen kuin "
                "aurinko nousee metsän ylle ja lämmittää pihan."),
               (-2, "Сегодня холодно, и дети не хотят идти в школу."),
               (-3, "qxzvkj wqpfgh zzkrtx vbnmqw xkcdqj jqwzpt hgfvbx"), (-4, "1 2 3 ж"),
               (-5, "今日は寒いので子供たちは学校に行きたくない")]
    odd_docs = spark.createDataFrame([(i, t, None) for i, t in strange], docs.schema)
    kept = {r.doc_id for r in language.keep_identified(docs.union(odd_docs)).collect()}
    assert not kept & {i for i, _ in strange}
    truth = language.language_id(docs).where("lang_pred <> 'und'").count()
    assert len(kept) >= 0.98 * truth


# --- toxicity -------------------------------------------------------------------

def test_toxicity_is_right_on_held_out_rows(spark):
    big = {t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels")}
    truth = {r.doc_id: r.toxic for r in big["labels"].collect()}
    rows = toxicity.toxicity(big["documents"], big["labels"]).collect()
    assert len(rows) == big["documents"].count()
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.predicted for r in held if truth[r.doc_id] == 1]) >= 0.75
    assert np.mean([r.predicted for r in held if truth[r.doc_id] == 0]) <= 0.03


def test_toxicity_odd_rows(spark, tables):
    none = tables["labels"].where("doc_id < 0")
    rows = toxicity.toxicity(odd(spark), none).collect()
    assert len(rows) == 6 and {r.predicted for r in rows} == {0}
    df = tables["documents"].select("doc_id", "text").union(odd(spark).select("doc_id", "text"))
    rows = toxicity.toxicity(df, tables["labels"].union(tables["labels"])).collect()
    assert len(rows) == 1006 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.toxicity(df.where("doc_id < 0"), tables["labels"]).count() == 0


def test_class_counts_pass_over_wordless_texts(spark):
    texts = ["a b c", "d b c"]
    for gaps in ([""], ["", "!!"], ["one", ""]):
        counted = []
        for rows in (texts, gaps + texts, texts[:1] + gaps + texts[1:], texts + gaps):
            df = spark.createDataFrame([(c, t) for t in rows for c in (True, False)],
                                       "toxic boolean, text string").coalesce(1)
            toxic, other = toxicity.class_counts(df, 0.5)
            counted.append([c.tolist() for x in (toxic, other) for c in (x.pair, x.kept, x.word_kept)])
        assert all(c == counted[0] for c in counted)


def test_toxicity_with_wordless_labelled_texts(spark):
    texts = ["" if i % 3 == 0 else f"foul w{i} bad" if i % 3 == 1 else f"fine w{i} good"
             for i in range(90)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 1)) for i in range(90)],
                                   "doc_id long, toxic int")
    rows = toxicity.toxicity(docs.coalesce(1), labels).collect()
    assert len(rows) == 90 and all(0 <= r.score <= 1 for r in rows)


def test_continuations_count_different_words(spark):
    texts = ["a b c b", "x b", "a b", None, "", "b"]
    known = np.sort(toxicity.word_keys(["b", "c", "zz"]))
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    counts, words = toxicity.continuation_counts(df, known)
    by = dict(zip(known.tolist(), counts.tolist(), strict=True))
    assert [by[int(k)] for k in toxicity.word_keys(["b", "c", "zz"])] == [3, 1, 0]
    assert words == 5


def test_shared_backoff_is_divided_by_all_distinct_pairs(spark):
    texts = ["a b c b", "x b", "a b", None, "", "b", "q r s", "q r s"]
    known = np.sort(toxicity.word_keys(["b", "c", "zz"]))
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    once, many = (toxicity.continuations(d.repartition(3), known) for d in (
        df, df.union(df).union(df)))
    assert once[1:] == (6, 9) and many[1:] == (6, 27)
    assert once[0].tolist() == many[0].tolist() and sorted(once[0]) == [0, 1, 3]


def test_second_words_of_kept_pairs_have_their_shared_value(spark):
    # "bar" comes after "foo" alone in the toxic texts, so only the pair outlives the discount.
    texts = [f"w{i} foo bar" for i in range(8)] + [f"v{i} is good" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts + [f"u{i} bar" for i in range(30)])),
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 8)) for i in range(48)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    bar = toxicity.word_keys(["bar"])
    assert bar not in model.classes[0].word and len(model.classes[0].pair)
    pairs = (8 + 1) + (40 + 1) + 30
    assert toxicity.Counts._find(model.words, bar, model.shared) == pytest.approx(31 / pairs)


def test_packed_pairs_come_back():
    codes = toxicity.mix64(np.arange(5_000, dtype=np.uint64))
    assert (toxicity.unmix64(codes) == np.arange(5_000, dtype=np.uint64)).all()
    for bits in (0, 3, 12):
        back = [toxicity.unpacked(d) for _, d in toxicity.packed(np.append(codes, codes), bits)]
        assert (np.concatenate(back) == np.sort(codes)).all()


# --- pipeline -------------------------------------------------------------------

def test_pipeline_stages(spark, tables):
    docs = tables["documents"]
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language", "toxicity", "near_duplicates", "secrets", "packing"]
    clean = language.language_id(docs).where("lang_pred <> 'und'").count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows, before = out.collect(), docs.count()
        if name == "language":
            assert len(rows) >= 0.98 * clean
        elif name == "near_duplicates":
            assert len(rows) == ngram_join.jaccard_join(docs).select("class_id").distinct().count()
        elif name == "secrets":
            assert len(rows) == before
            assert not any(secret_scan.base_spans(r.text) for r in rows)
        docs = spark.createDataFrame(rows, docs.schema)
    packed = corpus_pipeline.run(spark, SF)
    want = packing.best_fit(docs)
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert packed.select(keys).exceptAll(want.select(keys)).isEmpty()
    assert packed.agg({"length": "sum"}).head()[0] == want.agg({"length": "sum"}).head()[0]


def test_pipeline_odd_rows(spark):
    docs = odd(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() > 0
    docs = odd(spark).where("doc_id > 99")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
