"""The pipeline, stage by stage, against plain versions of what each keeps."""

import zlib
from collections import Counter, defaultdict

import data
import numpy as np
import test_llm_operators as plain
import test_near

import corpus_pipeline


def write(spark, folder, rows):
    docs = data.frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], int(len(set((r[1] or "").split())) > 8), 0) for r in rows if r[0] is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_stages(spark, tmp_path):
    write(spark, str(tmp_path), data.rows())
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "mix_sources", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}.parquet")
        docs, last = spark.read.parquet(f"{tmp_path}/{name}.parquet"), docs
        after = [tuple(r) for r in docs.collect()]
        if name != "best_fit_packing":
            assert docs.schema.simpleString() == last.schema.simpleString()
        if name == "quality_classifier":
            from lexloom.llm import mil

            model = mil.fit(last, spark.read.parquet(f"{tmp_path}/labels.parquet"))
            want = Counter((r.doc_id, r.text) for r in mil.scored(last, model).collect() if r.score >= 0.5)
            assert Counter(r[:2] for r in after) == want and 60 < len(after) < len(before)
        if name == "line_dedup":
            holders = defaultdict(set)
            key = lambda x: x.strip(plain.BLANK).translate(plain.LOW)
            for r in before:
                for x in (r[1] or "").split("\n"):
                    holders[key(x)].add(-1 if r[0] is None else r[0])
            gone = lambda x, d: len(key(x)) >= 40 and len(holders[key(x)]) >= 5 and max(holders[key(x)]) != d
            want = Counter((r[0], r[1] if r[1] is None else "\n".join(x for x in r[1].split("\n") if not gone(x, r[0]))) for r in before)
            assert Counter(r[:2] for r in after) == want and all(r[4] == (None if r[1] is None else len(r[1])) for r in after)
        if name == "simhash_near_dedup":
            # The stage's rule is five-word shingles at 0.8; that of two bits is op7's contract alone.
            sets = [test_near.shingles(r[1]) for r in before]
            near = lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
            left, groups = set(range(len(before))), []
            while left:
                group, front = set(), {left.pop()}
                while front:
                    i = front.pop()
                    group.add(i)
                    new = {j for j in left if near(i, j)}
                    left -= new
                    front |= new
                groups.append(group)
            ids = lambda g: [before[i][0] for i in g if before[i][0] is not None]
            assert Counter(r[0] for r in after) == Counter(min(ids(g)) if ids(g) else None for g in groups)
            assert len(after) < len(before)
        if name == "mix_sources":
            n = lambda rows: Counter({s: sum(len(plain.WORD.findall(r[1] or "")) for r in rows if r[3] == s) for s in {r[3] for r in rows}})
            was, now = n(before), n(after)
            assert all(now[s] <= 3 * was[s] for s in was) and abs(sum(now.values()) - sum(was.values())) <= len(was)
            assert {r[0] for r in after} <= {r[0] for r in before}
        if name == "best_fit_packing":
            lib = plain.library()
            want = Counter()
            for r in before:
                ids = lib.encode(r[1] or "", add_special_tokens=False).ids + [1]
                for k in range(0, len(ids), 4096):
                    want[(r[0], k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes()))] += 1
            assert Counter(r[:5] for r in after) == want
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(tuple(r)[:5] for r in whole.collect()) == Counter(r[:5] for r in after)


def test_empty(spark, tmp_path):
    write(spark, str(tmp_path), [r for r in data.rows() if r[0] == -5])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
