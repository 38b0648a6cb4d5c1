import zlib

import corpus_pipeline
import numpy as np

from palimpsest.llm import packing


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    clean = [(i, f"document number {i} has words of its own like " + " ".join(f"word{i}x{n}" for n in range(40 + i)), "en", "a" if i % 3 else "b") for i in range(30)]
    copies = [(100 + i, clean[2][1].replace(" ", "  "), "en", "a") for i in range(9)]
    near = [(200 + i, clean[20][1] + f" tail{i}", "en", "b") for i in range(5)]
    junk = [(300, None, "en", "a"), (301, "", None, None), (302, "123 !!", "en", "a")]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in clean + copies + near + junk], "doc_id long, text string, lang string, source string, n_chars long")
    docs, kept = df, []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        if number < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == df.columns
            kept.append(sorted(r["doc_id"] for r in docs.select("doc_id").collect()))
    everything = sorted(r[0] for r in clean + copies + near)
    assert kept[0] == everything
    assert kept[1] == sorted([r[0] for r in clean if r[0] != 2] + [100] + [r[0] for r in near])
    assert kept[2] == sorted([r[0] for r in clean if r[0] != 2] + [100])
    assert set(kept[3]) == set(kept[2])
    encoder = packing.encoder(packing.default_tokenizer())
    whole = {i: np.append(np.frombuffer(encoder.ids(t.encode()), "<u4"), 2).astype("<u4") for i, t, *_ in clean + copies}
    count = {}
    for r in docs.collect():
        ids = whole[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert zlib.crc32(ids.tobytes()) == r["ids_crc32"]
        count[r["doc_id"]] = count.get(r["doc_id"], 0) + r["length"]
    assert count == {i: len(whole[i]) * kept[3].count(i) for i in set(kept[3])}
    df.write.parquet(f"{tmp_path}/in/documents.parquet")
    again = corpus_pipeline.run(spark, f"{tmp_path}/in")
    assert sorted(map(tuple, again.drop("sequence_id", "offset").collect())) == sorted(map(tuple, docs.drop("sequence_id", "offset").collect()))
