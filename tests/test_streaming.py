import datetime as dt
import glob
import random
import shutil

from terrane.streaming.windows import event_windows

START = dt.datetime(2024, 1, 1)


def events(n, seed, hours):
    r = random.Random(seed)
    return [(i, START + dt.timedelta(seconds=r.randrange(3600 * hours)), r.choice("ab"), None if r.random() < 0.1 else float(r.randint(1, 9))) for i in range(n)]


def counted(rows):
    out = {}
    for _, ts, kind, v in rows:
        n, total = out.get((ts.replace(minute=0, second=0), kind), (0, None))
        out[ts.replace(minute=0, second=0), kind] = (n + 1, total if v is None else (total or 0) + v)
    return out


def test_windows_of_growing_files_lose_nothing(spark, tmp_path):
    """Rows in any order, windows still open, and a second run that goes on from the first one's state."""
    def add(rows, name):
        spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/new-{name}")
        (tmp_path / "events.parquet").mkdir(exist_ok=True)
        shutil.copy(glob.glob(f"{tmp_path}/new-{name}/*.parquet")[0], f"{tmp_path}/events.parquet/{name}.parquet")

    def run():
        return {(r.start, r.event_type): (r.n, r.value) for r in event_windows(spark, str(tmp_path), out=f"{tmp_path}/out").collect()}

    first, second = events(300, 1, 20), events(200, 2, 26)
    add(first, "a")
    assert run() == counted(first)
    assert run() == counted(first)
    add(second, "b")
    assert run() == counted(first + second)
