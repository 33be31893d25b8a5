import random

import corpus_pipeline
from tests.llm import test_op03_line_dedup as lines
from tests.llm import test_op04_decontaminate as leaks
from tidemark.llm.quality import score_quality

R = random.Random(11)
VOC = [f"w{i}" for i in range(60)] + ["the", "of", "and"]


def sentence(n):
    return " ".join(R.choice(VOC) for _ in range(n)).capitalize() + "."


def make(spark, path):
    rows, labels = [], []
    leak = sentence(30)
    for d in range(240):
        good = d % 6 > 0
        text = "\n".join(sentence(R.randint(15, 40)) for _ in range(4))
        if not good:
            text = " ".join(w + "$$$" for w in text.split())
        elif d % 20 == 1:
            text += "\n" + leak
        elif d % 20 == 3:
            text += "\nA line that many documents of this corpus have in common"
        rows.append([d, text, "en", f"s{d % 4}", len(text)])
        labels.append((d, int(good), 0))
    for d in range(240, 260):  # exact and near copies of good documents
        words = rows[d - 240 + 1][1].split(" ")
        if d % 2:
            words[len(words) // 2] = "changed"
        rows.append([d, " ".join(words), "fr", "copies", 0])
    rows += [[260, None, None, None, None], [261, "", "en", "s1", 0], [None, sentence(50), "en", "s2", 1]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows


def test_stages_do_their_jobs(spark, tmp_path):
    make(spark, str(tmp_path))
    sf_dir, docs = str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet")
    names, seen = [n for n, _ in corpus_pipeline.STAGES], {}
    for at, (name, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{at}")
        out = spark.read.parquet(f"{tmp_path}/{at}")
        if name != names[-1]:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = (docs.collect(), out.collect())
        docs = out
    assert names == ["quality", "line dedup", "near duplicates", "decontamination", "mix"]

    before, after = seen["quality"]
    scored = score_quality(spark.createDataFrame(before, docs.drop("copies", "taken").schema), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert {r.doc_id for r in after} == {r.doc_id for r in scored.collect() if r.score >= 0.3}
    assert not [r for r in after if r.text and "$$$" in r.text] and len([r for r in after if (r.doc_id or 0) < 240]) >= 195

    before, after = seen["line dedup"]
    want = lines.brute([(r.doc_id, r.text) for r in before])
    assert sorted(((r.doc_id, r.text or "") for r in after), key=str) == sorted(((d, t) for d, _, _, t in want), key=str)

    before, after = seen["near duplicates"]
    kept = {r.doc_id for r in after}
    texts = {}
    for r in before:
        texts.setdefault((r.text or "").lower(), set()).add(r.doc_id)
    assert all(len(ids & kept) == 1 and min(ids, key=lambda d: d or 0) in kept for ids in texts.values() if None not in ids and len(ids) > 1)
    assert len(kept & {d for d in range(240, 260) if d % 2}) <= 2
    assert kept >= {r.doc_id for r in before if (r.doc_id or 0) < 240 and r.text}

    before, after = seen["decontamination"]
    item = spark.read.parquet(f"{tmp_path}/benchmark.parquet").first().text
    grams = {tuple(leaks.words(item)[i : i + 10]) for i in range(21)}
    hit = {r.doc_id for r in before if any(tuple(leaks.words(r.text)[i : i + 10]) in grams for i in range(len(leaks.words(r.text))))}
    assert {r.doc_id for r in after} == {r.doc_id for r in before} - hit and hit

    before, after = seen["mix"]
    assert all(r.copies in (1, 2) and r.taken == r.copies * len(r.text.split()) for r in after)
    assert {r.doc_id for r in after} <= {r.doc_id for r in before}


def test_run_equals_the_stages(spark, tmp_path):
    make(spark, str(tmp_path))
    once = sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    assert once == sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) and len(once) > 20


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    """No documents, no labels, no benchmark: nothing fails; extra columns named as the operators' own come through."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, label long, copies string, a long, f0 long, n_words long, items string, n_dropped long"
    for rows in ([], [(d, f"Document {d} says what it says, twice over.", "en", "s", 1, 0.5, 3, "x", 1, 2, 3, "i", 4) for d in range(12)] + [(None,) * 13]):
        sf_dir = f"{tmp_path}/{len(rows)}"
        spark.createDataFrame(rows, schema).write.parquet(f"{sf_dir}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        for name, step in corpus_pipeline.STAGES[:-1]:
            out = step(spark, docs, sf_dir)
            assert out.columns == docs.columns, name
            assert all((r.score, r.n_words, r.items, r.n_dropped) in ((0.5, 3, "i", 4), (None,) * 4) for r in out.collect())
        out = corpus_pipeline.run(spark, sf_dir)
        assert out.count() == 0 or {"copies", "taken", "f0", "label"} <= set(out.columns)


def test_stages_hand_texts_to_python_in_batches_of_bounded_bytes(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tidemark.llm.common import BATCH_BYTES

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], ["bytes", "n"])

    before = spark.conf.get(BATCH_BYTES)
    docs = spark.range(0, 6000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 800).alias("text"))
    monkeypatch.setattr(corpus_pipeline, "keep_good", lambda docs, labels: docs.mapInArrow(sizes, "bytes long, n long"))
    try:
        got = dict(corpus_pipeline.STAGES)["quality"](spark, docs, "/root/testdata/sf0.001").collect()
    finally:
        spark.conf.set(BATCH_BYTES, before)
    assert sum(r.n for r in got) == 6000 and max(r.bytes for r in got) < 6 << 20
