"""The stages of the corpus pipeline on a small table, and its guard."""

import json
import random
import subprocess
import sys

import corpus_pipeline
from tests.conftest import ROOT
from tests.llm.helpers import prose

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, folder, rows, labels):
    spark.createDataFrame(rows, DOCS).repartition(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_stages(spark, tmp_path):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(300):
        words = prose(i, 80).split()
        bad = rng.random() < 0.2
        for _ in range(5 * bad):
            words[rng.randrange(80)] = rng.choice(["grumblefoul", "snarlwort", "blightpest"])
        text = " ".join(words)
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, 1, int(bad)))
    toxic = {i for i, _, t in labels if t}
    clean = [i for i in range(300) if i not in toxic]
    rows += [(1000 + i, rows[i][1], "en", "s0", 1) for i in clean[:20]]  # copies
    rows += [(2000, "write to me@home.example today please", "en", "s1", 1), (2001, None, None, None, None), (None, "row without an id", "en", "s1", 1)]
    folder = str(tmp_path)
    write(spark, folder, rows, labels)
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes], name
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept[name] = [r["doc_id"] for r in docs.collect()]
    assert not toxic & set(kept["toxicity"]) and set(clean) <= set(kept["toxicity"])
    assert not {1000 + i for i in clean[:20]} & set(kept["near_dedup"]) and set(clean) <= set(kept["near_dedup"])
    assert len(kept["pii"]) == len(kept["near_dedup"])
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/pii").collect()}
    assert text[2000] == "write to [EMAIL] today please"  # evidence of one text takes no ordinary words
    assert set(kept["mixing"]) <= set(kept["pii"]) and sorted(map(str, kept["sentencepiece"])) == sorted(map(str, kept["mixing"]))
    assert [r for r in corpus_pipeline.run(spark, folder).groupBy("doc_id").count().collect()]


def test_empty_table(spark, tmp_path):
    write(spark, str(tmp_path), [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_entry_works_without_the_subpackage(tmp_path):
    """A copy without llm and the pipeline still imports and lists its other queries."""
    code = f"""
import importlib.abc, sys, json
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path, target=None):
        if name == "corpus_pipeline" or name.startswith("lodestone.llm"):
            raise ImportError(name)
sys.meta_path.insert(0, Gone()); sys.path.insert(0, {ROOT!r})
import __spark_entry__ as e
print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, check=True)
    names, sql = json.loads(said.stdout.splitlines()[-1])
    assert not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in names) and set(sql) <= set(names)
