import numpy as np

from fieldmill.llm import op06_language_id as lang


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r["doc_id"]: r for r in lang.identify_languages(docs).collect()}
    held = [r for r in docs.collect() if rows[r["doc_id"]]["held_out"]]
    right = sum(rows[r["doc_id"]]["lang_pred"] == r["lang"] for r in held)
    assert len(held) > 150 and right >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_labels_of_held_out_rows_are_not_used(spark, sf_dir):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    changed = docs.withColumn("lang", F.when(lang.held_out(), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    a, b = ({r["doc_id"]: (r["lang_pred"], r["score"]) for r in lang.identify_languages(d).collect()} for d in (docs, changed))
    assert a == b


def test_vector_is_the_sum_of_bound_permuted_letters():
    letters = lang._letters()
    ids = lang.trigrams("Ab, c")
    assert [(i // lang.SYMBOLS**2, i // lang.SYMBOLS % lang.SYMBOLS, i % lang.SYMBOLS) for i in ids.tolist()] == [(0, 1, 2), (1, 2, 0), (2, 0, 3), (0, 3, 0)]
    wanted = sum(np.roll(letters[a], 2).astype(int) * np.roll(letters[b], 1) * letters[c] for a, b, c in [(0, 1, 2), (1, 2, 0), (2, 0, 3), (0, 3, 0)])
    assert (lang.document_vector("Ab, c") == wanted).all()


def test_table_of_trigrams_may_overflow(monkeypatch):
    text = " ".join(chr(0x4E00 + i) + chr(0x4E00 + 7 * i) for i in range(300))
    wanted = lang.document_vector(text)
    monkeypatch.setattr(lang, "KEPT_TRIGRAMS", 50)
    small = lang.TrigramVectors()
    ids, counts = np.unique(lang.trigrams(text), return_counts=True)
    assert np.allclose(small.bundle(ids, counts), wanted)


def test_defined_cases(odd_docs, no_docs):
    rows = lang.identify_languages(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r["doc_id"]: r for r in rows}
    for i in (0, 1, 2):
        assert (by_id[i]["lang_pred"], by_id[i]["score"]) == ("und", 0.0)
    assert all(r["lang_pred"] in ("en", "de") for r in rows if r["doc_id"] not in (0, 1, 2))
    assert lang.identify_languages(no_docs).count() == 0
    kept = lang.keep_identified(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 3
    assert kept.where("lang IS NULL").count() == 0


def test_predictions_equal_profiles_by_definition(spark, sf_dir):
    """Every prediction of a table against sums of bound vectors, written as loops."""
    letters = lang._letters().astype(int)

    def vector(text):
        total = np.zeros(lang.DIMENSIONS)
        for i in lang.trigrams(text or "").tolist():
            a, b, c = i // lang.SYMBOLS**2, i // lang.SYMBOLS % lang.SYMBOLS, i % lang.SYMBOLS
            total += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
        return total

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars < 1500")
    rows = docs.collect()
    found = {r["doc_id"]: r for r in lang.identify_languages(docs).collect()}
    vectors = {r["doc_id"]: vector(r["text"]) for r in rows}
    profiles = {}
    for r in rows:
        if not found[r["doc_id"]]["held_out"] and r["text"] is not None and r["lang"] is not None:
            profiles[r["lang"]] = profiles.get(r["lang"], 0) + vectors[r["doc_id"]]
    for r in rows:
        v = vectors[r["doc_id"]]
        if not v.any():
            continue
        cosines = {k: v @ p / np.linalg.norm(v) / np.linalg.norm(p) for k, p in profiles.items()}
        best = max(sorted(cosines), key=cosines.get)
        assert found[r["doc_id"]]["lang_pred"] == best and abs(found[r["doc_id"]]["score"] - min(1, max(0, cosines[best]))) < 1e-9


def test_too_many_languages_are_an_error(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(lang, "MOST_LANGUAGES", 2)
    rows = [(i, f"text number {x}", x) for i, x in enumerate("abcdef")]
    with pytest.raises(ValueError, match="values of lang"):
        lang.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
