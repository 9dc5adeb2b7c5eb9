"""Every stage of the pipeline against a plain version on its own input."""

import math
import zlib

import corpus_pipeline
from tests.llm.test_near_text import plain_survivors
from tests.llm.test_quality import Plain
from tests.llm.test_tokens import check_packing, library_ids
from txnrisk.llm import language
from txnrisk.llm.queries import BYTE_BPE

SF = "/root/testdata/sf0.001"


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def share_repeated(text):
    """Largest share of words equal to the word 1 to 4 before, 16 words more counted."""
    words = text.encode().lower().split()
    return max(sum(words[k] == words[k - c] for k in range(c, len(words))) for c in range(1, 5)) / (len(words) + 16)


def plain_quality(rows, good):
    """Ids that stay: {id: (text, lang)} and the trusted ids."""
    model = Plain([rows[i][0] for i in rows if i in good and not held_out(i)], 5)
    ppl = {i: model.perplexity(t) for i, (t, _) in rows.items() if t}
    measured = [i for i in ppl if i in good and held_out(i)]

    def quantile(values, q, lang):
        own = [v for i, v in values.items() if i in measured and rows[i][1] == lang]
        own = own if len(own) >= 30 else [v for i, v in values.items() if i in measured]
        return sorted(own)[max(0, math.ceil(q * len(own)) - 1)]

    judged = {}
    for i, v in ppl.items():
        n = len(rows[i][0].encode())
        judged[i] = math.exp((n * math.log(v) + 32 * math.log(quantile(ppl, 0.5, rows[i][1]))) / (n + 32))
    often = {i: share_repeated(t) for i, (t, _) in rows.items() if t}
    often_limit = {lang: 2 * quantile(often, 0.995, lang) if len(measured) >= 30 else math.inf for _, lang in rows.values()}
    limit = {lang: 1.1 * quantile(judged, 0.995, lang) for _, lang in rows.values()}
    return {i for i, v in judged.items() if v <= limit[rows[i][1]] * (1 + 1e-7) and often[i] <= often_limit[rows[i][1]]}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    rows = {r.doc_id: (r.text, r.lang) for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "language", "near_dedup", "packing"]

    after = stages["quality"](spark, docs, SF)
    assert after.columns == corpus_pipeline.COLUMNS and dict(after.dtypes) == dict(docs.dtypes)
    kept = {r.doc_id for r in after.collect()}
    assert kept == plain_quality(rows, good) and 0 < len(kept) < len(rows)

    after = docs.where(docs.doc_id.isin(list(kept)))
    model = language.train_on(after, language.Settings())
    names, scores = language.predict(model, [rows[i][0] for i in sorted(kept)])
    want = {i for i, n, s in zip(sorted(kept), names, scores)
            if any(c.isalpha() for c in rows[i][0]) and n != "und" and s >= corpus_pipeline.LANGUAGE_SCORE}
    got = stages["language"](spark, after, SF)
    assert got.columns == corpus_pipeline.COLUMNS and {r.doc_id for r in got.collect()} == want

    after = docs.where(docs.doc_id.isin(list(want)))
    survivors = plain_survivors({i: rows[i][0] for i in want})
    got = stages["near_dedup"](spark, after, SF)
    assert got.columns == corpus_pipeline.COLUMNS
    first = {r.doc_id: r.text for r in got.collect()}
    assert set(first) == survivors and all(first[i] == rows[i][0] for i in first)

    ids = {i: library_ids(BYTE_BPE, [t])[0] for i, t in first.items()}
    packed = stages["packing"](spark, docs.where(docs.doc_id.isin(list(first))), SF).collect()
    check_packing(packed, {i: len(x) + 1 for i, x in ids.items()}, 2048)

    whole = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.piece, r.length) for r in whole} == {(r.doc_id, r.piece, r.length) for r in packed}
    assert len({r.sequence_id for r in whole}) == len({r.sequence_id for r in packed})


def test_odd_rows(spark, odd_docs, no_docs, tmp_path):
    folder = str(tmp_path)
    labels = spark.createDataFrame([(i, 1) for i in range(15)] + [(None, 1)], "doc_id long, quality int")
    labels.write.parquet(f"{folder}/labels.parquet")
    odd = odd_docs.unionByName(odd_docs.where("doc_id = 3")).unionByName(
        odd_docs.where("doc_id = 4").withColumn("doc_id", odd_docs.doc_id.cast("string").substr(9, 1).try_cast("long")))
    for frame in (odd, no_docs):
        frame.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
        rows = corpus_pipeline.run(spark, folder).collect()
        assert bool(rows) == (frame is odd)
    assert all(r.doc_id is not None for r in rows)
