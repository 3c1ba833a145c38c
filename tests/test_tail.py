"""Log files that grow between two runs of a stream."""

import json

import pytest
from pyspark.sql import functions as F

from hunkledger.session import work_path
from hunkledger.sources.audit import write_audit
from hunkledger.sources.tail import TailReader
from hunkledger.streaming.audit import audit_stream, tail_audit


def entry(n, **more):
    return json.dumps({"timestamp": "2024-05-05T00:00:00Z", "action": "skip", "message": f"m{n}", "line": n, **more})


@pytest.fixture
def log(spark, tmp_path):
    out, checkpoint = work_path(spark, "tail-out"), work_path(spark, "tail-ckpt")

    class Log:
        def append(self, repo, *lines, end="\n"):
            folder = tmp_path / "logs" / repo
            folder.mkdir(parents=True, exist_ok=True)
            with open(folder / "audit.jsonl", "ab") as handle:
                handle.write("\n".join(lines).encode() + end.encode())

        def run(self):
            tail_audit(spark, str(tmp_path / "logs"), out, checkpoint).awaitTermination()
            return sorted((r.repo, r.log_seq, r.message) for r in spark.read.parquet(out).collect())

        path = tmp_path / "logs"

    return Log()


def test_appended_lines_are_read_once(log):
    log.append("a", entry(1), "not json", "", entry(2))
    first = log.run()
    assert [r[2] for r in first] == ["m1", "m2"]
    assert log.run() == first
    log.append("a", entry(3), entry(4))
    log.append("b", entry(5))
    second = log.run()
    assert len(second) == len(first) + 3 and set(first) < set(second)
    raw = (log.path / "a" / "audit.jsonl").read_bytes()
    assert all(json.loads(raw[at:].split(b"\n")[0])["message"] == message for repo, at, message in second if repo == "a")


def test_an_unfinished_line_waits_for_its_end(log):
    whole = entry(2)
    log.append("a", entry(1), whole[:10], end="")
    assert [r[2] for r in log.run()] == ["m1"]
    log.append("a", whole[10:])
    assert [r[2] for r in log.run()] == ["m1", "m2"]


def test_a_shorter_file_is_a_new_one_and_hidden_files_are_none(log):
    log.append("a", *(entry(n) for n in range(5)))
    log.append("_temporary", entry(8))
    (log.path / "a" / ".audit.crc").write_text(entry(9) + "\n")
    assert len(log.run()) == 5
    (log.path / "a" / "audit.jsonl").write_text(entry(7) + "\n")
    assert [r[2] for r in log.run()].count("m7") == 1


@pytest.mark.parametrize("split", [1, 7, 64, 10_000])
def test_every_cut_gives_the_same_lines(tmp_path, monkeypatch, split):
    texts = ["", "a", "é" * 30, "x" * 200, "", "\r", "last"]
    raw = "\n".join(texts).encode() + b"\n\xff\n" + b"y" * 500 + b"\nunfinished"
    (tmp_path / "repo").mkdir()
    (tmp_path / "repo" / "audit.jsonl").write_bytes(raw)
    monkeypatch.setattr("hunkledger.sources.tail.CHUNK_BYTES", 16)
    reader = TailReader({"path": str(tmp_path), "splitbytes": str(split)})
    end = reader.latestOffset()
    assert end == {"repo/audit.jsonl": raw.rindex(b"\n") + 1}
    got = [row for part in reader.partitions({}, end) for b in reader.read(part) for row in zip(*b.to_pydict().values())]
    want, at = [], 0
    for line in raw.split(b"\n")[:-1]:
        want.append(("repo/audit.jsonl", at, line.decode("utf-8", "replace")))
        at += len(line) + 1
    assert got == want
    half = {"repo/audit.jsonl": want[4][1]}
    assert [row[1] for part in reader.partitions(half, end) for b in reader.read(part) for row in zip(*b.to_pydict().values())] == [w[1] for w in want[4:]]
    assert reader.partitions(end, end) == []


def test_audit_stream_counts_a_line_appended_to_a_file_it_has_read(spark, tmp_path):
    src, out, ckpt = str(tmp_path / "log"), work_path(spark, "days"), work_path(spark, "ckpt")
    day = lambda d: json.dumps({"timestamp": f"2024-05-{d:02}T12:00:00Z", "action": "skip"})
    row = spark.createDataFrame([("org/a+b", "2024-05-01T12:00:00Z")], "repo string, timestamp string")
    write_audit(row, src, F.lit("x"))
    (file,) = (tmp_path / "log").rglob("part-*.txt")

    def run():
        for q in audit_stream(spark, src, out, ckpt):
            q.awaitTermination()
        return {(r.start.day, r.repo): r.n for r in spark.read.parquet(f"{out}/daily").collect()}

    assert run() == {}
    with open(file, "a") as handle:
        handle.write(day(1) + "\n" + day(4) + "\n")
    assert run() == {(1, "org/a+b"): 2}
