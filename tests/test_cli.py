import csv

from matchloom.__main__ import main
from matchloom.sources import runlog


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "p").write_bytes(b"he\nshe\n#x\n")
    (tmp_path / "t").write_bytes(b"ushers she")
    (tmp_path / "e").write_bytes(b"# nothing\n")
    args = ["--patterns", str(tmp_path / "p"), "--input", str(tmp_path / "t"), "--warmup", "0", "--iters", "1"]
    assert main([*args, "--searcher", "pthread_dynamic", "--print-matches", "--threads", "2"], spark) == 0
    out = capsys.readouterr().out
    assert out.count("pat=") == 4 and "pthread_dynamic" in out
    assert main([*args, "--searcher", "none"], spark) == 1 and main(["--list"], spark) == 0 and main([], spark) == 2
    assert main(["--patterns", str(tmp_path / "e"), "--input", str(tmp_path / "t")], spark) == 1
    assert main(["--patterns", str(tmp_path / "none"), "--input", str(tmp_path / "t")], spark) == 1
    capsys.readouterr()
    assert main([*args, "--searcher", "sequential", "--format", "csv"], spark) == 0
    head, row = csv.reader(x for x in capsys.readouterr().out.splitlines() if not x.startswith("#"))
    assert len(head) == len(row) == 18 and row[1] == "sequential" and row[5] == "4"


def test_output_is_read_back(spark, tmp_path, capsys):
    """What the command line prints is a log that the sources read: results, workers and figures."""
    text = b"ushers say she is hers and his " * 400
    (tmp_path / "p").write_bytes(b"he\nshe\nhis\nhers\n")
    (tmp_path / "t").write_bytes(text)
    every = sum(text.count(p) for p in (b"he", b"she", b"his", b"hers"))
    phase = tmp_path / "run" / "A_speedup_curves"
    phase.mkdir(parents=True)
    for name in ("pthread_chunked", "pthread_dynamic", "pattern_sharded_prefix"):
        args = ["--patterns", str(tmp_path / "p"), "--input", str(tmp_path / "t"), "--warmup", "0", "--iters", "2", "--threads", "2", "--per-thread"]
        assert main([*args, "--searcher", name], spark) == 0
        (phase / f"p4__text__{name}__T2.log").write_text(capsys.readouterr().out)
    logs = runlog.read_logs(spark, str(tmp_path / "run"))
    runs = runlog.parse_runs(logs)
    rows = {r["searcher"]: r for r in runs.collect()}
    assert len(rows) == 3 and all((r["matches"], r["bytes"], r["thr"], r["wrk"], r["pattern_count"], r["automaton_states"], r["iters"], r["patterns"]) == (every, len(text), 2, 2, 4, 10, 2, "p4") and r["build_ms"] is not None and r["mbps"] > 0 for r in rows.values())
    workers = {}
    for r in runlog.parse_workers(runs, logs).collect():
        workers.setdefault(r["searcher"], []).append(r)
    assert all(sum(w["matches_found"] for w in own) == every for own in workers.values())
    assert sorted(w["bytes_scanned"] for w in workers["pthread_chunked"]) == [len(text) // 2, len(text) // 2 + 3]
    assert sum(w["bytes_scanned"] for w in workers["pthread_dynamic"]) == 8 * -(-len(text) // 8)
    assert {w["bytes_scanned"] for w in workers["pattern_sharded_prefix"]} == {len(text)}


def test_ranges_of_a_large_file(spark, tmp_path, capsys):
    (tmp_path / "p").write_bytes(b"he\nshe\n")
    (tmp_path / "t").write_bytes(b"ushers she " * 1000)
    args = ["--patterns", str(tmp_path / "p"), "--input", str(tmp_path / "t"), "--warmup", "0", "--iters", "1", "--searcher", "pthread_dynamic", "--chunk", "777"]
    assert main(args, spark) == 0
    out = capsys.readouterr().out
    assert "via byte ranges" in out and next(x for x in out.splitlines() if x.startswith("pthread")).split()[7] == "4000"
