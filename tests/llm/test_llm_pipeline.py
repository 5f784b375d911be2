"""The corpus pipeline, stage by stage and whole, against brute force."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from llm_fixtures import SCHEMA, Groups, split
from test_llm_dedup import brute_fingerprint, brute_removals, line_rows
from test_llm_quality_secrets import measured
from tokenizers import Tokenizer

import corpus_pipeline
from epiwatch.llm.secret_scan import redacted, spans_of, trained

COLUMNS = [f.name for f in SCHEMA.fields]
LAST = 2**63 - 1


def without_lines(spark, rows):
    gone = brute_removals(spark, rows)
    out = []
    for i, t, lang, source, n in rows:
        places = gone.get((LAST if i is None else i, t))
        if not places:
            out.append((i, t, lang, source, n))
        elif split(cut := "\n".join(x for k, x in enumerate(t.split("\n")) if k not in places)):
            out.append((i, cut, lang, source, len(cut)))
    return out


def one_of_each(rows):
    g, fps = Groups(), [brute_fingerprint(t) for _, t, *_ in rows]
    for x in fps:
        for y in fps:
            if (x ^ y).bit_count() <= 3:
                g.join(x, y)
    first = {}
    for (i, *_), x in zip(rows, fps, strict=True):
        root = g.find(x)
        first[root] = min(LAST if i is None else i, first.get(root, LAST))
    kept = {}
    for row, x in zip(rows, fps, strict=True):
        if first[g.find(x)] == (LAST if row[0] is None else row[0]):
            kept.setdefault(g.find(x), row)
    return list(kept.values())


def test_stages_and_run(spark, rows, tmp_path):
    some = [r for r in rows if r[1] is None or len(r[1]) < 5000]  # brute force is quadratic in a line
    more = [(1000 + (i or 0), (t or "") + " " + " ".join(f"w{i}x{k}" for k in range(25)) + "\npassword=abcdefgh%d" % (i or 0), *rest)
            for i, t, *rest in line_rows()[:30]]
    now = some + [(*r[:4], len(r[1])) for r in more]
    spark.createDataFrame(now, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "line dedup", "SimHash near-dedup", "secret scans", "best-fit packing"]

    def step(name, want):
        nonlocal docs
        docs = corpus_pipeline.written(stages[name](spark, docs, str(tmp_path)), "test")
        assert docs.columns == COLUMNS
        assert Counter(map(tuple, docs.collect())) == Counter(want), name
        return want

    now = step("quality rules", [r for r in now if measured(r[1] or "")[6]])
    assert len(now) < len(some) + len(more)
    now = step("line dedup", without_lines(spark, now))
    now = step("SimHash near-dedup", one_of_each(now))
    net = trained(docs)
    found = [spans_of([t], net)[0] for _, t, *_ in now]
    now = step("secret scans", [(i, redacted(t, s), a, b, len(redacted(t, s)) if s else n) for (i, t, a, b, n), s in zip(now, found, strict=True)])
    assert sum("[SECRET]" in t for _, t, *_ in now) > 5
    library = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    want = Counter()
    for i, t, *_ in now:
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            want[i, k // 4096, k, len(ids[k:k + 4096]), zlib.crc32(ids[k:k + 4096].tobytes())] += 1
    pieces = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(map(tuple, stages["best-fit packing"](spark, docs, str(tmp_path)).select(*pieces).collect())) == want
    assert Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select(*pieces).collect())) == want


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
