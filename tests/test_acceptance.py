"""Golden cases of token-weighted acceptance, read in batch and as a stream."""

import os
import random

import pytest

from evalweave.operators.aggregates import acceptance_rate
from evalweave.sources import logs
from evalweave.streaming.acceptance import drain_until


def record(accepted, proposed):
    return f"speculative_accepted_tokens: {accepted}, speculative_proposed_tokens: {proposed}\n"


@pytest.fixture
def log(tmp_path):
    path = tmp_path / "rank_0.log"
    path.write_text("")
    return path


def batch(spark, path, **options):
    counts = logs.acceptance_counts(logs.read_log(spark, str(path), **options))
    return tuple(acceptance_rate(counts).first())


def stream(spark, tmp_path, path, name="a", expected=None, **options):
    lines = logs.stream_log(spark, str(path), **options)
    return drain_until(spark, lines, str(tmp_path / f"cp-{name}"), str(tmp_path / f"out-{name}"), expected)


def both(spark, tmp_path, path, **options):
    a = batch(spark, path, **options)
    assert stream(spark, tmp_path, path, **options) == a
    return a


def test_weighted_by_tokens(spark, tmp_path, log):
    log.write_text(record(1, 1) + record(0, 9))
    assert both(spark, tmp_path, log) == (10.0, 2)


def test_history_before_the_offset_is_skipped(spark, tmp_path, log):
    log.write_text(record(0, 100))
    start = logs.snapshot_offsets(str(log))
    with log.open("a") as f:
        f.write(record(9, 10))
    assert both(spark, tmp_path, log, startingOffsets=start) == (90.0, 1)


def test_snapshot_within_an_unfinished_line(spark, tmp_path, log):
    log.write_text(record(0, 100) * 3 + "speculative_accepted_tokens: 5")
    start = logs.snapshot_offsets(str(log))
    assert both(spark, tmp_path, log, startingOffsets=start) == (None, 0)
    with log.open("a") as f:
        f.write("0, speculative_proposed_tokens: 50\n" + record(3, 4))
    # the rest of that line is no record of its own
    assert batch(spark, log, startingOffsets=start) == (75.0, 1)
    assert stream(spark, tmp_path, log, startingOffsets=start) == (75.0, 1)


def test_invalid_records_do_not_count(spark, tmp_path, log):
    log.write_text("speculative_token_acceptance_rate: 0.9\n" + record(2, 1) + record(1, 2).rstrip("\n"))
    assert both(spark, tmp_path, log) == (None, 0)


def test_nothing_proposed(spark, tmp_path, log):
    log.write_text(record(0, 0))
    assert both(spark, tmp_path, log) == (None, 1)


def test_folder_means_rank_zero(spark, tmp_path, log):
    log.write_text(record(1, 2))
    (tmp_path / "rank_1.log").write_text(record(0, 10))
    assert list(logs.log_files(str(tmp_path))) == [str(log)]
    assert batch(spark, tmp_path) == (50.0, 1)


def test_pattern_takes_the_newest_and_warns(tmp_path, log):
    other = tmp_path / "rank_1.log"
    other.write_text(record(1, 1))
    os.utime(other, (2000000000, 2000000000))
    with pytest.warns(UserWarning, match="newest"):
        assert list(logs.log_files(str(tmp_path / "*.log"))) == [str(other)]


def test_late_records_are_waited_for(spark, tmp_path, log):
    now = [0.0]

    def sleep(seconds):
        now[0] += seconds
        log.write_text(record(3, 4))

    lines = logs.stream_log(spark, str(log))
    got = drain_until(spark, lines, str(tmp_path / "cp"), str(tmp_path / "out"), 1, max_wait=3,
                      sleep=sleep, clock=lambda: now[0])
    assert got == (75.0, 1)
    assert now[0] > 0


@pytest.mark.parametrize("text,expected", [("", 2), (record(1, 2) * 2, 1)])
def test_other_counts_warn(spark, tmp_path, log, text, expected):
    log.write_text(text)
    with pytest.warns(UserWarning, match="instead of"):
        stream(spark, tmp_path, log, expected=expected)


def test_truncated_log_starts_over(spark, tmp_path, log):
    log.write_text(record(0, 100) * 10)
    start = logs.snapshot_offsets(str(log))
    log.write_text(record(1, 2))
    assert both(spark, tmp_path, log, startingOffsets=start) == (50.0, 1)


def test_stream_resumes_and_restarts_on_truncation(spark, tmp_path, log):
    log.write_text(record(1, 2) * 3 + "speculative_accepted_tokens: 9")
    assert stream(spark, tmp_path, log) == (50.0, 3)
    with log.open("a") as f:
        f.write("9\n" + record(0, 4))
    rate, n = stream(spark, tmp_path, log)
    assert (round(rate, 6), n) == (30.0, 4)
    log.write_text(record(10, 10))  # shorter: read from the start, sums go on
    assert stream(spark, tmp_path, log) == (65.0, 5)


def test_ranges_split_lines_once(spark, log):
    text = "".join(f"{'x' * (i % 17)}{i}\n" for i in range(500))
    log.write_text(text)
    for width in ("7", "64", "1000000"):
        rows = logs.read_log(spark, str(log), rangeBytes=width).orderBy("pos").collect()
        assert [r.line for r in rows] == text.splitlines()
        assert all(text[r.pos:].startswith(r.line + "\n") for r in rows)


def test_rolled_files_all_count(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"part-{i}.log").write_text(record(i, 4))
    assert batch(spark, tmp_path / "*.log", every="true") == (25.0, 3)


def test_many_logs_cost_the_driver_one_listing(tmp_path, monkeypatch):
    for k in range(300):
        (tmp_path / f"{k}.log").write_text("one\ntwo")
    opened = []
    ends = logs._complete_end
    monkeypatch.setattr(logs, "_complete_end", lambda path, size: opened.append(path) or ends(path, size))
    parts = logs.ByteLogReader({"path": f"{tmp_path}/*.log", "every": "true"}).partitions()
    assert len(parts) == 300 and not opened
    assert [b.column("line").to_pylist() for p in parts[:2] for b in logs._read(p)] == [["one"], ["one"]]
    stream = logs.ByteLogStream({"path": f"{tmp_path}/*.log", "every": "true"})
    assert set(stream.latestOffset().values()) == {4} and len(opened) == 300
    (tmp_path / "7.log").write_text("one\ntwo\n")
    assert sorted(set(stream.latestOffset().values())) == [4, 8] and len(opened) == 301


def read_ranges(path, size, width, first=0):
    parts = logs._ranges({str(path): first}, {str(path): size}, width)
    return [(b["pos"].to_pylist(), b["line"].to_pylist()) for p in parts for b in logs._read(p)]


@pytest.mark.parametrize("block", [1, 3, 16, 1 << 18])
def test_blocks_of_a_range_do_not_matter(log, monkeypatch, block):
    monkeypatch.setattr(logs, "BLOCK_BYTES", block)
    monkeypatch.setattr(logs, "TAIL_BYTES", max(1, block // 2))
    r = random.Random(block)
    for end in ("\n", "", "open"):
        data = ("\n".join("é" * r.choice([0, 0, 1, 2, 9, 40]) for _ in range(60)) + end).encode()
        log.write_bytes(data)
        starts = [0] + [i + 1 for i, c in enumerate(data) if c == 10]
        for first in (0, starts[7], starts[7] + 1):
            want = [(first, data[first:].split(b"\n")[0])] + [(a, data[a:].split(b"\n")[0]) for a in starts if a > first]
            want = [(a, x.decode("utf-8", "ignore")) for a, x in want if data.find(b"\n", a) >= 0]
            for width in (1, 7, 64, 1 << 20):
                got = [x for places, lines in read_ranges(log, len(data), width, first) for x in zip(places, lines)]
                assert got == want, (end, first, width)


def test_a_range_is_never_held_as_a_whole(log):
    log.write_text(record(3, 4) * 60_000 + "x" * 5_000_000 + "\n" + record(1, 2))
    batches = read_ranges(log, log.stat().st_size, logs.RANGE_BYTES)
    assert sum(len(lines) for _, lines in batches) == 60_002
    assert sorted(sum(map(len, lines)) for _, lines in batches)[-2] <= logs.BLOCK_BYTES
