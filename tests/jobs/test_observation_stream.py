import glob
import math
import os
import random
import shutil
from statistics import median

import pytest
from jobs import observation_stream as S

from tests.differential import connect, duck_rows, spark_rows

SMALL = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def rows(lo, hi, seed):
    r = random.Random(seed)
    out = []
    for i in range(lo, hi):
        y = [r.gauss(0.3, 1) for _ in range(2)]
        x = [y[0] + r.gauss(0, 0.2), r.gauss(0, 1), y[1] if i % 3 == 1 else r.gauss(0, 1)]
        out.append((i, [*y, *x], i % 3 if i % 11 else None))
    return out


def pearson(a, b):
    n = len(a)
    ma, mb = sum(a) / n, sum(b) / n
    aa, bb, ab = sum((x - ma) ** 2 for x in a), sum((y - mb) ** 2 for y in b), sum((x - ma) * (y - mb) for x, y in zip(a, b))
    return round(ab / math.sqrt(aa * bb), 6) if math.sqrt(aa * bb) > 1e-9 else 0.0


def brute(data):
    """(gene, enh) -> (global, best local, its domain, its size, advantage, specificity)."""
    out = {}
    for g in range(2):
        for e in range(3):
            by = {}
            for _, v, label in data:
                if v is not None and len(v) == 5 and not any(math.isnan(k) for k in (v[g], v[2 + e])):
                    by.setdefault(-1 if label is None else label, []).append((max(v[2 + e], 0), max(v[g], 0)))
            local = sorted((-pearson(*zip(*p)), d) for d, p in by.items())
            whole = pearson(*zip(*[x for p in by.values() for x in p]))
            best, at = -local[0][0], local[0][1]
            others = median(-x for x, _ in local[1:])
            out[g, e] = (whole, best, at, len(by[at]), round(best - whole, 6), round(best - others, 6))
    return out


def config(at):
    return S.Config(f"{at}/in", f"{at}/out", f"{at}/state", first_target=0, targets=2, first_driver=2, drivers=3, files_per_batch=1)


def add(spark, at, data, name):
    """One more file in the folder, which appears whole."""
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(f"{at}/new-{name}")
    os.makedirs(f"{at}/in", exist_ok=True)
    shutil.copy(glob.glob(f"{at}/new-{name}/*.parquet")[0], f"{at}/in/{name}.parquet")


def screened(spark, at):
    return {(r.gene, r.enh): (r.global_concordance, r.max_regional_concordance, r.best_domain, r.best_domain_size, r.local_advantage, r.regional_specificity) for r in S.screened(spark, f"{at}/out").collect()}


def agrees(found, data):
    wanted = brute(data)
    assert found.keys() == wanted.keys()
    for k, v in wanted.items():
        assert found[k] == pytest.approx(v, abs=3e-6), k


def test_growing_input(spark, tmp_path):
    """Each run takes the new files only, and screens all that came before with them."""
    c = config(tmp_path)
    first, second = rows(0, 150, 1), [*rows(150, 220, 2), (900, None, 1), (901, [1.0], 1), (902, [float("nan"), 1.0, 1.0, 1.0, 1.0], 0)]
    add(spark, tmp_path, first, "a")
    assert S.run(spark, c) == {"read": 150, "batches": 1, "written": 6}
    agrees(screened(spark, tmp_path), first)
    add(spark, tmp_path, second, "b")
    add(spark, tmp_path, rows(300, 330, 3), "c")
    assert S.run(spark, c) == {"read": 103, "batches": 2, "written": 6}
    after = screened(spark, tmp_path)
    agrees(after, first + second + rows(300, 330, 3))
    files = set(glob.glob(f"{tmp_path}/out/moments/*/*.parquet"))
    assert S.run(spark, c) == {"read": 0, "batches": 0, "written": 6}
    assert screened(spark, tmp_path) == after and set(glob.glob(f"{tmp_path}/out/moments/*/*.parquet")) == files
    classes = {(r.gene, r.enh): (r.predicted_class, r.best_domain) for r in S.screened(spark, f"{tmp_path}/out").collect()}
    assert classes[0, 0][0] == "core_concordant" and classes[1, 2][1] == 1 and classes[1, 2][0] != "unsupported" and classes[0, 1][0] == "unsupported"


def test_a_batch_that_failed_is_not_counted_twice(spark, tmp_path, monkeypatch):
    """A run that dies after a batch was written, and before it was committed, is made good by the next."""
    c = config(tmp_path)
    add(spark, tmp_path, rows(0, 120, 4), "a")
    written = S.log.info

    def dies(text, *args):
        written(text, *args)
        raise RuntimeError("lost")

    with monkeypatch.context() as m, pytest.raises(Exception, match="lost"):
        m.setattr(S.log, "info", dies)
        S.run(spark, c)
    assert glob.glob(f"{tmp_path}/out/moments/batch=0/*.parquet")
    assert S.run(spark, c) == {"read": 120, "batches": 1, "written": 6}
    agrees(screened(spark, tmp_path), rows(0, 120, 4))


def test_no_files_yet(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    assert S.run(spark, config(tmp_path)) == {"read": 0, "batches": 0, "written": 0}
    add(spark, tmp_path, rows(0, 60, 5), "a")
    assert S.run(spark, config(tmp_path))["read"] == 60


def test_an_empty_table(spark, tmp_path):
    add(spark, tmp_path, [], "a")
    assert S.run(spark, config(tmp_path))["written"] == 0 and S.screened(spark, f"{tmp_path}/out").collect() == []


def test_query_agrees_with_sql(spark):
    from jobs.queries import ORACLES, QUERIES

    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    assert spark_rows(QUERIES["job1_observation_stream"](spark, SMALL)) == duck_rows(connect(SMALL), ORACLES["job1_observation_stream"])
    assert before == (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode"))


def test_command_line(spark, tmp_path, monkeypatch):
    add(spark, tmp_path, rows(0, 50, 6), "a")
    (tmp_path / "c.yaml").write_text("observations: nowhere\nout: nowhere\ncheckpoint: nowhere\nfirst_target: 0\ntargets: 2\nfirst_driver: 2\ndrivers: 3\nevidence:\n  core: 0.2\n")
    seen = []
    monkeypatch.setattr(S, "run", lambda session, c: seen.append(c))
    monkeypatch.setattr(type(spark), "stop", lambda self: seen.append("stopped"))
    S.main(["--config", str(tmp_path / "c.yaml"), "--observations", f"{tmp_path}/in", "--out", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/state"])
    assert seen[0].observations == f"{tmp_path}/in" and seen[0].evidence.core == 0.2 and seen[0].files_per_batch == 64 and seen[1:] == ["stopped"]
