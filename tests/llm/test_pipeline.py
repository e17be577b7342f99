"""The pipeline's stages, one after the other, and its registration."""

import zlib

import __spark_entry__ as entry
import corpus_pipeline
from sightline.llm import simhash


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = [{r.doc_id: r.text for r in docs.collect()}]
    assert len(corpus_pipeline.STAGES) == 5
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        assert k == 4 or out.columns == columns
        out.write.parquet(path := str(tmp_path / str(k)))
        docs = spark.read.parquet(path)
        kept.append({r.doc_id: r.text if k < 4 else r.n_tokens for r in docs.collect()})
        assert set(kept[-1]) <= set(kept[-2]) and docs.count() == len(kept[-1])
    known = [d for d in kept[0] if d in labels and zlib.crc32(str(d).encode()) % 5 == 0]
    assert sum((d in kept[1]) == labels[d] for d in known) > 0.93 * len(known)
    assert all(kept[1][d] == kept[0][d] for d in kept[1])
    seen = set()
    for d in sorted(kept[2]):  # no line of five words or more is left twice
        for line in kept[2][d].split("\n"):
            line = line.strip(" \t\r")
            assert len(line.split(" ")) < 5 or line not in seen
            seen.add(line)
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.read.parquet(str(tmp_path / "1"))).collect()}
    assert set(kept[3]) == {d for d, c in groups.items() if c == d or not kept[2][d].strip()}
    leaked = {d for d in kept[3] if any(b in kept[3][d] for b in bench)}
    assert not leaked & set(kept[4]) and len(kept[3]) - len(kept[4]) <= len(leaked) + 5
    assert set(kept[5]) == set(kept[4]) and all(kept[5][d] > 0 for d in kept[5] if kept[4][d])


def test_stages_handle_an_empty_table(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).collect() == []
