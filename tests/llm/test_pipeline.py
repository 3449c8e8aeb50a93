"""The pipeline's stages, each held against its own input, and the registry."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lattica.llm import decontaminate, neardup, packing, quality, registry, simhash
from lattica.llm.common import stored, table

ROOT = Path(__file__).parents[2]
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")


def test_stages_take_effect(spark):
    docs = table(spark, SF, "documents")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(stored(stage(spark, seen[-1], SF), f"test-{name}"))
    for d in seen[1:-1]:
        assert d.columns == docs.columns
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in seen]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False))
    # Quality: what goes is what the classifier rejects.
    judged = {r["doc_id"]: r["predicted"] for r in quality.classify(docs, table(spark, SF, "labels")).collect()}
    assert ids[1] == {i for i, p in judged.items() if p}
    # Line dedup: documents stay, no text grows, and lines keep their order.
    before, after = ({r["doc_id"]: r["text"] for r in d.collect()} for d in seen[1:3])
    assert ids[1] == ids[2]
    for i, t in after.items():
        rest = iter(before[i].split("\n"))
        assert t == "" or all(line in rest for line in t.split("\n"))
    # Near copies: no two fingerprints within the limit are left, and no one goes without a neighbour.
    kept = {i: simhash.fingerprint(t) for i, t in after.items() if i in ids[3]}
    gone = {i: simhash.fingerprint(t) for i, t in after.items() if i not in ids[3]}
    near = lambda a, b: (a ^ b).bit_count() <= simhash.BITS
    assert not any(near(a, b) for i, a in kept.items() for j, b in kept.items() if i < j)
    assert all(any(near(a, b) for j, b in (kept | gone).items() if j != i) for i, a in gone.items())
    # Benchmark: nothing is left to find.
    assert not decontaminate.report(seen[4], table(spark, SF, "benchmark")).filter(F.col("contaminated")).count()
    # Packing: the pieces are the last documents' tokens.
    encode = packing.Encoder()
    assert seen[5].agg(F.sum("length")).first()[0] == sum(len(encode(r["text"])) // 4 + 1 for r in seen[4].collect())


def test_stages_on_empty_tables_and_null_rows(spark):
    docs = table(spark, SF, "documents")
    odd = docs.limit(0).unionByName(spark.createDataFrame([(1, None, None, None, None), (None, "", "en", "s", 0), (None, None, None, None, None), (2, "a b c", "en", None, 5), (2, "a b c", "en", None, 5)], docs.schema))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        assert stage(spark, odd, SF).count() <= 5, name
    near = sorted((r["doc_id"] or 0, r["text"] or "") for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, odd, SF).collect())
    assert near == [(1, ""), (2, "a b c")]  # one of the texts without words, one of the copies


def test_near_copies_left_are_below_the_similarity(spark):
    """The third stage against all pairs of its own input."""
    docs = stored(table(spark, SF, "documents"), "test-docs")
    sets = {r["doc_id"]: neardup.shingles(r["text"]) for r in docs.collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()}
    near = lambda a, b: neardup.jaccard(sets[a], sets[b]) >= neardup.LEAST
    ids = sorted(sets)
    assert not any(near(a, b) for a in kept for b in kept if a < b)
    assert all(any(near(a, b) for b in ids if b != a) for a in ids if a not in kept)


def test_registry():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES) and len(registry.QUERIES) == 10


def test_entry_works_without_the_subpackage(tmp_path):
    for p in ("__spark_entry__.py", "lattica"):
        subprocess.run(["cp", "-r", ROOT / p, tmp_path], check=True)
    subprocess.run(["rm", "-rf", tmp_path / "lattica/llm"], check=True)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') and k[2].isdigit() for k in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, check=True).stdout
    assert out.split()[1] == "False" and int(out.split()[0]) > 30
