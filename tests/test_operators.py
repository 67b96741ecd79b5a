"""Behaviour that the derived tables don't show: goldens and properties on small inputs."""

import json
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from vetta.functions import needles
from vetta.functions.columns import glob, glob_column, normal_title, percentage, redact, truncate_bytes
from vetta.operators import findings, flow, records, scoring, suppress, text, vectors
from vetta.schemas import CWE_PAIRS, TITLE_STOPWORDS
from vetta.sources import documents, readers, writers
from vetta.streaming import jobs

FINDING = "id string, title string, severity string, confidence string, status string, exploitability string, fix_priority string, cwe string, file string, line_start int, function string, tags array<string>, created_by string, created_at long"


def finding(id="F-1", **values):
    base = dict(id=id, title="SQL injection in getUser", severity="high", confidence="high", status="open", exploitability="", fix_priority="", cwe="CWE-89", file="a/b.py", line_start=3, function="f", tags=["x"], created_by="agent-1", created_at=0)
    return tuple((base | values).values())


def test_fixed_values():
    assert len(TITLE_STOPWORDS) == 26 and len(CWE_PAIRS) == 40


def test_titles_and_fingerprints(spark):
    rows = spark.createDataFrame([finding("1"), finding("2", title="Possible SQL injection in getUser()", line_start=99), finding("3", cwe=" cwe-89 "), finding("4", title="SQL injection in getOther"), finding("5", function=" ")], FINDING)
    found = {r["id"]: r["fingerprint"] for r in findings.with_fingerprint(rows).collect()}
    assert found["1"] == found["2"] == found["3"] and len(set(found.values())) == 3
    assert spark.range(1).select(normal_title(F.lit("The  Bug: of (THE) `x`!"))).first()[0] == "x"


def test_dedup_keeps_creators_apart(spark):
    rows = findings.with_fingerprint(spark.createDataFrame([finding("1", created_at=5), finding("2", created_at=3), finding("3", created_by="agent-2"), finding("4", created_by=""), finding("5", created_by="")], FINDING))
    assert sorted(r["id"] for r in findings.dedup_findings(rows).collect()) == ["2", "3", "4", "5"]
    assert sorted(r["id"] for r in findings.dedup_findings(rows, rows.where("id = '1'")).collect()) == ["3", "4", "5"]


def test_validation_order(spark):
    rows = spark.createDataFrame([finding("1", title="", file=""), finding("2", severity=""), finding("3", severity="HIGH", confidence=""), finding("4", line_start=0), finding("5", status="odd"), finding("6", confidence="sure")], FINDING)
    found = {r["id"]: (r["error"], r["severity"], r["confidence"]) for r in findings.validate_findings(rows).collect()}
    assert found["1"][0] == "title is required" and found["2"][0] is None and found["3"] == (None, "high", "medium")
    assert found["4"][0] == "line_start must be at least 1" and found["5"][0] == "invalid status" and found["6"][0] == "invalid confidence"


def test_globs(spark):
    rows = spark.createDataFrame([("tests/*.py", "tests/a.py"), ("tests/*.py", "tests/x/a.py"), ("m?.py", "m1.py"), ("a.b", "axb")], "g string, p string")
    assert [r[0] for r in rows.select(F.regexp_like("p", glob_column(F.col("g")))).collect()] == [True, False, True, False]
    assert glob("a*.p?") == r"^a[^/]*\.p[^/]$"


def test_first_exception_wins(spark):
    rows = findings.with_fingerprint(spark.createDataFrame([finding("1"), finding("2", cwe="CWE-79"), finding("3", cwe="")], FINDING))
    print_ = rows.where("id = '2'").first()["fingerprint"]
    exceptions = spark.createDataFrame([("late", "", "a/*.py", "cwe-89", "r", 100, "x", 2), ("first", "", "b.py", "CWE-89", "r", 100, "x", 1), ("old", "", "a/*.py", "CWE-89", "r", 9, "x", 0), ("print", print_, "", "", "r", 100, "x", 3)], "id string, fingerprint string, path_glob string, cwe string, reason string, expires long, approved_by string, pos int")
    assert {r["id"]: r["exception_id"] for r in suppress.with_suppression(rows, exceptions, 10).collect()} == {"1": "first", "2": "print", "3": None}


def test_triage_in_order(spark):
    rows = spark.createDataFrame([finding("1"), finding("2")], FINDING)
    plan = spark.createDataFrame([("1", "confirmed", "a", "", "t", 1), ("1", "fixed", "", "low", "t", 2), ("1", "", "b", "", "t", 3), ("x", "fixed", "", "", "t", 4), ("", "fixed", "", "", "t", 5), ("2", "odd", "", "", "t", 6)], "finding_id string, status string, reason string, severity_override string, author string, pos int")
    found = {r["id"]: (r["status"], r["severity"], r["notes"]) for r in findings.apply_triage(rows, plan).collect()}
    assert found == {"1": ("fixed", "low", ["t: a", "t: b"]), "2": ("open", "high", [])}
    assert sorted(r["outcome"] for r in findings.judged_decisions(plan, rows).collect()) == ["applied"] * 3 + ["error"] * 2 + ["skipped"]


def serial(edges, order):
    used, out = set(), {}
    for v in order:
        best = None
        for f, s in sorted(edges.get(v, {}).items()):
            if f not in used and s >= 0.3 and (best is None or s > best[1]):
                best = (f, s)
        if best:
            used.add(best[0])
            out[v] = best[0]
    return out


def test_greedy_rounds_equal_the_serial_choice(spark):
    rand = random.Random(7)
    rows, wanted = [], set()
    for run in range(12):
        edges = {f"v{v}": {f"f{f}": rand.choice([0.2, 0.3, 0.5, 0.5, 0.9]) for f in rand.sample(range(6), rand.randint(0, 5))} for v in range(6)}
        rows += [(run, v, f, s, "m") for v, e in edges.items() for f, s in e.items()]
        wanted |= {(run, v, f) for v, f in serial(edges, sorted(edges)).items()}
    pairs = spark.createDataFrame(rows, "run_id int, vuln_id string, id string, score double, method string")
    gt = spark.createDataFrame([(f"v{v}", v) for v in range(6)], "vuln_id string, pos int")
    assert {(r["run_id"], r["vuln_id"], r["id"]) for r in scoring.greedy_match(pairs, gt).collect()} == wanted


@pytest.mark.parametrize("block", [1, 3, 100])
def test_blocks_of_truths_equal_the_serial_choice(spark, block):
    """Chains of truths that all want the same findings, over one and over many blocks; a run without matches gives no row."""
    rand = random.Random(block)
    some = lambda *x: rand.choice(x)
    gt = [(f"v{k:02}", k // 2, some("sql injection login", "reflected xss", ""), some("CWE-89", "CWE-564", "cwe-79", ""), some("a.py", "b/c.py"), some(0, 5, 30), ["web"]) for k in range(14)]
    runs = [(k % 3, f"f{k:02}", some("sql injection login", "sql", "other"), some("open", "open", "duplicate"), some("CWE-89", "CWE-79", "", "CWE-1"), some("x/a.py", "b/c.py", "z"), some(0, 5, 30), some(["WEB"], [], None)) for k in range(40)] + [(9, "f99", "other", "open", "", "z", 0, [])]
    gt = spark.createDataFrame(gt, "vuln_id string, pos int, title string, cwe string, file string, line_start int, tags array<string>")
    runs = spark.createDataFrame(runs, "run_id int, id string, title string, status string, cwe string, file string, line_start int, tags array<string>")
    pairs = scoring.score_pairs(gt, runs)
    edges = {}
    for r in pairs.collect():
        edges.setdefault(r["run_id"], {}).setdefault(r["vuln_id"], {})[r["id"]] = r["score"]
    wanted = {(run, v, f) for run, e in edges.items() for v, f in serial({k: e.get(k, {}) for k in sorted(e)}, sorted(e)).items()}
    for found in (scoring.match_runs(gt, runs, block=block), scoring.greedy_match(pairs, gt, block=block)):
        assert {(r["run_id"], r["vuln_id"], r["id"]) for r in found.collect()} == wanted


def test_scores(spark):
    gt = spark.createDataFrame([("V1", "SQL injection login", "critical", "CWE-89", "app.py", 62, ["sql"])], "vuln_id string, title string, severity string, cwe string, file string, line_start int, tags array<string>")
    run = "run_id int, id string, title string, severity string, status string, cwe string, file string, line_start int, tags array<string>"
    runs = spark.createDataFrame([(0, "a", "SQL injection login", "high", "open", "CWE-564", "x/app.py", 62, ["SQL"]), (0, "b", "other", "high", "open", "", "xapp.py", 500, None), (0, "c", "SQL injection login", "high", "duplicate", "CWE-89", "app.py", 62, ["sql"]), (0, "d", "SQL injection login", "high", "open", "CWE-1", "z.py", 62, ["sql"])], run)
    found = {r["id"]: (r["score"], r["method"]) for r in scoring.score_pairs(gt, runs).collect()}
    assert found == {"a": (1.0, "file+line"), "b": (0.2, "file")}
    assert {r["id"]: r["score"] for r in scoring.score_pairs(gt, runs, exact_cwe=True).collect()}["a"] == pytest.approx(0.6)
    assert {r["id"]: r["method"] for r in scoring.score_pairs(gt, runs, tolerance=0).collect()}["a"] == "cwe"


@pytest.mark.parametrize(("line", "told"), [('cur.execute("select", (x,))', "guarded"), ('cur.execute(f"select {x}")', "unguarded"), ('cur.execute("a" + x)', "unguarded"), ("cur.execute(q)", ""), ("cur.execute(q", ""), ('cur.execute("a, b")', ""), ('os.system("ls %s" % x)', "unguarded")])
def test_sink_arguments(spark, line, told):
    rows = spark.createDataFrame([(line,)], "text string")
    assert flow.classify_sink_args(rows, flow.sink_pattern()[0]).first()["args"] == told


def code(spark, body):
    return text.lines(spark.createDataFrame([("a.py", body)], "path string, content string"))


def verdict(spark, body, source="request", sink=None):
    rows = code(spark, body)
    sink = sink or flow.sink_pattern()[0]
    chains = flow.chains(rows, source, sink)
    return [(r["source_line"], r["sink_line"], r["verdict"]) for r in flow.chain_verdict(chains, flow.chain_steps(chains, rows)).orderBy("source_line").collect()]


def test_chains(spark):
    assert verdict(spark, "from flask import request\nx = request.args\ny = x\nos.system(y)") == [(2, 4, "unguarded")]
    assert verdict(spark, "x = request.args\ny = shlex.quote(x)\nos.system(y)") == [(1, 3, "guard-uncertain")]
    assert verdict(spark, "x = request.args\ny = sanitize(x)\nos.system(y)\neval(x)") == [(1, 3, "guarded")]
    assert verdict(spark, "os.system(x)\nx = request.args") == []
    assert flow.sink_pattern(["sqli", "nosuch"])[1] == ["nosuch"]
    rows = code(spark, "\n".join(["request"] * 12 + ["eval(x)"]))
    assert flow.chains(rows, "request", r"eval\(").count() == 8


def test_long_lines_don_t_overflow(spark):
    rows = spark.createDataFrame([("a", 1, "x" * 60_000 + ' f"' + "a" * 60_000)], "path string, line_no int, text string")
    assert rows.where(F.col("text").rlike(flow.sink_pattern()[0])).count() == 0


def test_units_cover_their_lines(spark):
    body = "\n".join(map(str, range(1, 251)))
    rows = text.split_units(spark.createDataFrame([("a", "u", 1, body), ("b", "s", 1, "x")], "file string, name string, start_line int, content string")).orderBy("file", "start_line").collect()
    own = [(r["start_line"], r["end_line"]) for r in rows if r["file"] == "a"]
    assert own == [(1, 95), (91, 185), (181, 250)] and rows[-1]["type"] == "unit"
    assert [r["content"].split("\n")[0] for r in rows[:3]] == ["1", "91", "181"]


def test_code_chunks(spark):
    body = "class A:\n    def f(self):\n        return 1\n\n    def g(self):\n        pass\nX = 1\ndef h():\n    pass"
    found = {r["name"]: (r["type"], r["start_line"], r["end_line"]) for r in text.code_chunks(spark.createDataFrame([("a.py", body)], "path string, content string"), "python").collect()}
    assert found == {"A": ("class", 1, 6), "f": ("method", 2, 4), "g": ("method", 5, 6), "h": ("function", 8, 9)}
    body = "func (s *S) F() {\n  if x {\n  }\n}\ntype T struct {\n a int\n}\nfunc G() {}\n"
    found = {r["name"]: (r["type"], r["start_line"], r["end_line"]) for r in text.code_chunks(spark.createDataFrame([("a.go", body)], "path string, content string"), "go").collect()}
    assert found["F"] == ("method", 1, 4) and found["T"] == ("struct", 5, 7) and found["G"][1] == 8


def test_lines_of_both_kinds(spark):
    files = spark.createDataFrame([("a", "x\r\ny\n"), ("b", None)], "path string, content string")
    assert [r["text"] for r in text.lines(files).where("path = 'a'").orderBy("line_no").collect()] == ["x\r", "y", ""]
    assert [r["text"] for r in text.lines(files, keep_last=False).where("path = 'a'").orderBy("line_no").collect()] == ["x", "y"]


def test_byte_truncation(spark):
    rows = spark.createDataFrame([("é" * 10,), ("abc",)], "t string").select(truncate_bytes(F.col("t"), 5, "!"))
    assert [r[0] for r in rows.collect()] == ["éé!", "abc"]
    assert spark.range(1).select(redact(F.lit("key secret12 x"), "secret12")).first()[0] == "key [REDACTED] x"
    assert spark.range(1).select(percentage(F.lit(1), F.lit(0))).first()[0] == 0


def test_results_of_payloads(spark):
    rows = spark.createDataFrame([('{"total": 2}',), ('{"total": 0}',), ('{"findings": [{}]}',), ("x",), (None,)], "j string")
    assert [r[0] for r in rows.select(text.has_results("j")).collect()] == [True, False, True, False, False]


def test_logs(spark):
    rows = spark.createDataFrame([(0, "fine"), (0, "Rate limit hit"), (1, "unexpected EOF and quota"), (1, "invalid yaml"), (1, "odd"), (0, "x" * 16384 + "quota")], "exit_code int, log string")
    assert [r["kind"] for r in text.classify_logs(rows).collect()] == ["clean", "silent failure", "hard", "recoverable", "hard", "clean"]


def test_note_search(spark):
    rows = spark.createDataFrame([("a", "context", "authentication tokens"), ("b", "stack", "authentication"), ("c", "stack", "nothing here")], "name string, type string, content string")
    assert [r["name"] for r in text.search_notes(rows, "authentication token").collect()] == ["a", "b"]


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [-1.0, 0.0]), (4, [1.0, 1.0]), (5, [1.0])], "chunk_id long, embedding array<float>")
    found = vectors.topk(spark.createDataFrame([(9, [2.0, 0.0])], "query_id long, embedding array<float>"), rows, 5).orderBy("place").collect()
    assert [(r["chunk_id"], round(r["score"], 4)) for r in found] == [(1, 1.0), (4, 0.7071), (2, 0.0), (5, 0.0), (3, -1.0)]
    many = rows.where("size(embedding) = 2").select(F.col("chunk_id").alias("query_id"), "embedding")
    key = lambda df: sorted(map(tuple, df.select("query_id", "chunk_id", "place").collect()))
    assert key(vectors.topk(many, rows, 2, block=2, part=1)) == key(vectors.topk(many, rows, 2))


def test_searches_by_group(spark):
    rows = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [1.0, 0.1]), (3, "b", [1.0, 0.2]), (4, "b", [0.0, 1.0]), (5, "c", [-1.0, 0.0]), (6, "c", None)], "chunk_id long, file string, embedding array<float>")
    near = vectors.related_to_files(rows.where("file = 'a'"), rows, 2).orderBy("place").collect()
    assert [(r["file"], r["chunk_id"]) for r in near] == [("a", 3), ("a", 4)]
    asked = rows.where("chunk_id in (1, 5)").select(F.col("chunk_id").alias("query_id"), "embedding")
    assert [tuple(r) for r in vectors.related(asked, rows, 1).select("query_id", "chunk_id").orderBy("query_id").collect()] == [(1, 2), (5, 4)]
    best = vectors.multi_hop(asked, rows, 2).orderBy("query_id", "place").collect()
    assert [(r["query_id"], r["chunk_id"], r["hop"]) for r in best] == [(1, 1, 0), (1, 2, 0), (5, 5, 0), (5, 4, 0)]
    assert vectors.topk(asked.limit(0), rows, 2).count() == 0 == vectors.topk(asked, rows.limit(0), 2).count()


def test_index_actions_cover_all_paths(spark):
    kind = "path string, mtime long, size long, sha256 string"
    old = spark.createDataFrame([("gone", 1, 1, "a"), ("same", 1, 1, "a"), ("moved", 1, 1, "a"), ("new", 1, 1, "a")], kind)
    new = spark.createDataFrame([("same", 1, 1, "b"), ("moved", 2, 1, "a"), ("new", 2, 1, "b"), ("first", 1, 1, "a")], kind)
    assert {r["path"]: r["action"] for r in records.index_diff(old, new).collect()} == {"gone": "delete", "same": "skip", "moved": "touch", "new": "reindex", "first": "first_index"}


def test_sarif_in_and_out(spark, tmp_path):
    doc = {"runs": [{"tool": {"driver": {"name": "s", "rules": [{"id": "p.r1", "shortDescription": {"text": "Opengrep Finding: p.r1"}, "fullDescription": {"text": ""}, "defaultConfiguration": {"level": "note"}, "properties": {"tags": ["CWE-89: SQL"]}}]}}, "results": [{"ruleId": "p.r1", "level": "error", "message": {"text": "Bad thing. More."}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "file:///repo/a.py"}, "region": {"startLine": 4, "endLine": 5, "snippet": {"text": "x"}}}}]}, {"ruleId": "p.r1", "message": {"text": ""}, "locations": []}]}]}
    (tmp_path / "x.sarif.json").write_text(json.dumps(doc))
    rows = readers.read_sarif(spark, f"file://{tmp_path}", "/repo").orderBy("nth").collect()
    assert [(r["title"], r["severity"], r["cwe"], r["file"], r["line_start"]) for r in rows] == [("Bad thing", "high", "CWE-89", "a.py", 4), ("r1", "low", "CWE-89", None, 1)]
    out = writers.to_sarif(spark.createDataFrame([finding("1") + ("p",)], FINDING + ", project string"), "project").first()["sarif"]
    assert json.loads(out)["runs"][0]["results"][0]["ruleId"] == "CWE-89"


def test_finding_files(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("id: F-1\ntitle: T\nseverity: high\nlocation: {file: x.py, line_start: 3}\n")
    (tmp_path / "b.yaml").write_text("a: [")
    rows = readers.read_findings(spark, f"file://{tmp_path}").collect()
    assert [(r["id"], r["file"], r["line_start"], len(r["fingerprint"])) for r in rows] == [("F-1", "x.py", 3, 64)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], FINDING)
    assert findings.dedup_findings(findings.with_fingerprint(none)).count() == 0
    assert findings.finding_stats(none).count() == 0
    assert findings.severity_share(none).count() == 0
    assert findings.same_file_hint(none).count() == 0


def test_numbers_of_a_large_group_go_on_from_range_to_range(spark):
    rows = [("a" if k % 10 else None if k % 20 else "b", (k * 37) % 500 // 3, k) for k in range(500)]
    found = {r["k"]: r["_n"] for r in findings.numbered(spark.createDataFrame(rows, "g string, at int, k int"), "g", ["at", "k"]).collect()}
    wanted = {}
    for g in ("a", "b", None):
        wanted |= {k: n for n, (_, _, k) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:]), 1)}
    assert found == wanted
    assert findings.numbered(spark.createDataFrame([], "g string, at int, k int"), "g", ["at", "k"]).count() == 0


def test_default_embedding_counts_hashed_words(spark):
    texts = ["one two two", "", None, "Two"]
    got = [r["embedding"] for r in vectors.embed(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string"), "t").orderBy("k").collect()]
    for t, v in zip(texts, got):
        counts = [0.0] * 64
        for w in (t or "").lower().split():
            counts[zlib.crc32(w.encode()) % 64] += 1
        length = math.sqrt(sum(x * x for x in counts)) or 1
        assert v == pytest.approx([x / length for x in counts], abs=1e-6)


def test_recall_by_severity(spark):
    gt = spark.createDataFrame([("v1", "High"), ("v2", "high"), ("v3", "low")], "vuln_id string, severity string")
    runs = spark.createDataFrame([(0, "a"), (1, "b")], "run_id int, id string")
    hits = spark.createDataFrame([(0, "v1", "a"), (0, "v3", "c")], "run_id int, vuln_id string, id string")
    got = sorted(tuple(r) for r in scoring.severity_recall(hits, gt, runs).collect())
    assert got == [(0, "high", 2, 1, 0.5), (0, "low", 1, 1, 1.0), (1, "high", 2, 0, 0.0), (1, "low", 1, 0, 0.0)]


def test_block_ends_equal_the_plain_search(spark):
    rand = random.Random(3)
    source = {p: [" " * rand.randint(0, 4) + rand.choice(["{", "}", "{ {", "} {", "x", "", "# c"]) for _ in range(60)] for p in ("a", "b")}
    rows = spark.createDataFrame([(p, n, t) for p, ts in source.items() for n, t in enumerate(ts, 1)], "path string, line_no int, text string").cache()
    starts = rows.where("line_no % 3 = 1").select("path", "line_no")
    braces, indents = set(), set()
    for p, ts in source.items():
        depth = [0]
        for t in ts:
            depth.append(depth[-1] + t.count("{") - t.count("}"))
        deep = [len(t) - len(t.lstrip(" ")) for t in ts]
        for n in range(1, 61, 3):
            braces.add((p, n, next((m for m in range(n + 1, 61) if depth[m] <= depth[n - 1]), 60)))
            indents.add((p, n, next((m - 1 for m in range(n + 1, 61) if ts[m - 1].strip() not in ("", "# c") and deep[m - 1] <= deep[n - 1]), 60)))
    assert {tuple(r) for r in text.brace_block_end(rows, starts.union(starts)).collect()} == braces
    assert {tuple(r) for r in text.indent_block_end(rows, starts).collect()} == indents
    assert text.brace_block_end(rows.limit(0), starts).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for k, x in enumerate(a):
        new = [k + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_terms_with_one_edit_share_a_key(spark):
    rand = random.Random(3)
    words = ["".join(rand.choice("abé") for _ in range(n)) for n in [1, 1, 2, 2, 3, 4, 5, 59, 60, 61, 63, 64, 65, 66, 200] for _ in range(2)]
    near = lambda w: [w[:k] + rand.choice(["", "z", w[k : k + 1] + "q"]) + w[k + 1 :] for k in rand.sample(range(len(w)), min(len(w), 4))]
    words = sorted({w for x in words for w in [x, *near(x)] if w})
    keys = {r["w"]: set(r["k"]) for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", text.near_keys(F.col("w")).alias("k")).collect()}
    for a in words:
        for b in words:
            assert edits(a, b) > 1 or keys[a] & keys[b], (a, b)
    assert all(len(k) < 70 for k in keys.values())


def test_notes_are_found_by_all_fields_and_by_type(spark):
    rows = [("deploy-plan", "context", "Deploying services", "how it runs", ["ops"]), ("b", "pattern", "the service", None, None), ("c", "stack", None, "", []), ("d", "pattern", "", "deploys", ["Ops"])]
    notes = spark.createDataFrame(rows, "name string, type string, content string, description string, tags array<string>")
    names = lambda *a, **b: [r["name"] for r in text.search_notes(notes, *a, **b).collect()]
    assert names("deployed") == ["d", "deploy-plan"] or names("deployed") == ["deploy-plan", "d"]
    assert names("deplxy") == ["d", "deploy-plan"] and names("deplxy", type="pattern") == ["d"] and names("deploy", 1) == ["d"]
    assert names("ops") == ["d", "deploy-plan"][1:] + ["d"] or set(names("ops")) == {"deploy-plan", "d"}  # Ops is one edit away and counts half
    assert names("stacks") == ["c"] and names("the of") == [] and names("") == []


def test_contained_names(spark):
    rand = random.Random(5)
    bodies = [(k, "".join(rand.choice("abcé ") for _ in range(rand.randint(0, 60)))) for k in range(150)] + [(900, None), (901, "x" * 5000 + "needle")]
    names = ["a", "é", "ab", "abc", "cab ", "aaaa", "abcab", "é é", "needle", "", None, "b" * 40]
    found = {tuple(r) for r in needles.contained(spark.createDataFrame(bodies, "id int, body string"), "id", "body", spark.createDataFrame([(n,) for n in names], "word string"), "word").collect()}
    assert found == {(k, n) for k, t in bodies if t for n in names if n and n in t}
    one = spark.createDataFrame(bodies, "id int, body string").select("id", needles.words_in(F.col("body"), ["abc", "ab", "needle"]).alias("w")).collect()
    assert {r["id"]: r["w"] for r in one} == {k: None if t is None else [w for w in ("ab", "abc", "needle") if w in t] for k, t in bodies}


def test_audit_names_agents_and_links(spark):
    notes = spark.createDataFrame([("API map", "see THE PLAN and api maps"), ("the plan", ""), ("lone", None)], "name string, content string")
    needed = spark.createDataFrame([("b", "gone"), ("a", "gone"), ("a", "API map")], "agent string, name string")
    assert {tuple(r) for r in records.context_audit(notes, needed).collect()} == {("missing", "gone", "a,b"), ("referenced", "the plan", "1"), ("orphan", "lone", "")}


def test_candidates_are_the_checklist_s(spark):
    notes = spark.createDataFrame([("n", "context", "Opens a Path with sqlite and sql"), ("m", "context", None)], "name string, type string, content string")
    hints = spark.createDataFrame([("CWE-89", "sql"), ("CWE-89", "sqlite"), ("CWE-22", "open")], "cwe string, word string")
    rated = lambda checklist: [tuple(r) for r in records.hypotheses("SQLite", notes, hints, checklist=checklist).collect()]
    assert rated(None) == [("CWE-89", 5), ("CWE-22", 1)] == rated(spark.createDataFrame([], "cwe string"))
    assert rated(spark.createDataFrame([("CWE-22",), ("CWE-1",)], "cwe string")) == [("CWE-22", 1)]


def test_sensitive_directories(spark):
    files = spark.createDataFrame([("p", "src/apiAuth/x.py"), ("p", "node_modules/token/a.js"), ("p", "Webhooks/in/y"), ("p", "auth.py")], "project string, path string")
    assert {(r["path"], r["reason"]) for r in text.sensitive_areas(files).collect()} == {("src/apiAuth/", "Authentication logic"), ("Webhooks/", "Webhook handlers")}


CHANGE = "path string, at timestamp, removed boolean, mtime long, size long, sha256 string"
PARTS = "path string, mtime long, size long, sha256 string, part int"


def parts_of(files):
    return files.select("path", "mtime", "size", "sha256", F.explode(F.sequence(F.lit(0), F.col("size").cast("int"))).alias("part"))


def test_an_index_by_batches_is_that_of_one_batch(spark, tmp_path):
    """Removals, files that come back, equal hashes, a path that the listing has lost, and batches that come again."""
    rand = random.Random(4)
    rows = [(k // 12, (f"p{rand.randrange(9)}", k, rand.random() < 0.2, k, 2, rand.choice("xy"))) for k in range(36)]
    frame = lambda wanted: spark.createDataFrame([r for b, r in rows if b in wanted], CHANGE.replace("timestamp", "long")).withColumn("at", F.timestamp_seconds("at"))
    listing = spark.createDataFrame([(f"p{k}",) for k in range(8)], "path string")
    stores = [f"file://{tmp_path}/{k}" for k in range(3)]
    for k in (0, 1, 2):
        jobs.merge_batch(frame({k}), k, stores[0], parts_of, PARTS, listing, buckets=4)
    for k in (0, 1, 1, 2, 1, 2):
        jobs.merge_batch(frame({k}), k, stores[1], parts_of, PARTS, listing, buckets=4)
    jobs.merge_batch(frame({0, 1, 2}), 0, stores[2], parts_of, PARTS, listing, buckets=4)
    last = {r[0]: r for _, r in sorted(rows, key=lambda x: x[1][1])}
    wanted = sorted((p, r[3], 2, r[5], n) for p, r in last.items() if not r[2] and p != "p8" for n in range(3))
    for store in stores:
        assert sorted(map(tuple, jobs.current_index(spark, store, PARTS).collect())) == wanted
    jobs.merge_batch(frame({2}).limit(0), 3, stores[0], parts_of, PARTS, listing.limit(0), buckets=4)
    assert jobs.current_index(spark, stores[0], PARTS).count() == 0


def test_history_keeps_what_came_first(spark, tmp_path):
    history = f"file://{tmp_path}/history"
    rows = lambda *r: spark.createDataFrame([(f, c, a) for f, c, a in r], "fingerprint string, created_by string, at int")
    keys = ["fingerprint", "created_by"]
    new = lambda batch, k, run="a": sorted((str(r[0]), r[1], r[2]) for r in jobs.new_against_history(batch, k, history, run, keys).collect())
    first = rows(("f", "x", 3), ("f", "x", 2), (None, "x", 1), (None, "x", 4))
    assert new(first, 0) == new(first, 0) == [("None", "x", 1), ("f", "x", 2)]
    assert new(rows(("f", "x", 1), ("f", "y", 1), (None, "x", 9)), 1) == [("f", "y", 1)]
    assert new(rows(("f", "y", 1), ("g", "y", 1)), 0, "b") == [("g", "y", 1)]


def test_pairs_of_shuffled_batches(spark, tmp_path):
    from vetta.plans.io_queries import drained, replay_in_parts, state_store

    rand = random.Random(6)
    events = [(rand.randrange(3), k, rand.choice(["start", "end"]), 1_700_000_000_000_000 + rand.randrange(3_600_000_000)) for k in range(60)]
    wanted, opened = set(), {}
    for agent, k, kind, at in sorted(events, key=lambda e: (e[3], e[1])):
        if kind == "start":
            opened[agent] = at
        elif agent in opened:
            began = opened.pop(agent)
            if at - began <= 3_600_000_000:
                wanted.add((agent, k, (at - began) // 1000))
    schema = "agent int, event_id long, kind string, at_us long"
    rand.shuffle(events)
    frames = [spark.createDataFrame(events[k::3], schema) for k in range(3)] + [spark.createDataFrame([(9, 99, "tick", 1_800_000_000_000_000)], schema)]
    with state_store(spark, "RocksDBStateStoreProvider"):
        found = drained(jobs.pair_events(replay_in_parts(frames, "events", 1), "2 hours", hours=1), spark)
    assert {tuple(r) for r in found.collect()} == wanted and wanted


def whole(spark, rows, path):
    """Each project's document: its part files one after the other."""
    import pathlib

    documents.write_documents(rows, f"file://{path}")
    return {d.name.partition("=")[2]: "".join(p.read_text() for p in sorted(d.glob("part-*"))) for d in pathlib.Path(path).glob("project=*")}


def reported(spark):
    schema = FINDING + ", project string, description string, impact string, snippet string, evidence array<struct<type: string, description: string, trace: array<string>>>, flow_trace struct<source: string, sink: string, path: array<string>, guards: array<string>, unguarded: boolean>"
    one = finding("F-1", title='a "quoted" <title>\n2') + ("p", "what & why", None, "x()", [("code", "seen", ["a", "b"])], ("in", "out", ["s"], ["g"], True))
    two = finding("F-2", cwe="", line_start=0, function="", tags=[], severity="low") + ("p", "", "bad", "", None, None)
    return spark.createDataFrame([one, two, finding("F-3") + ("q", None, None, None, [], None)], schema)


def test_documents_are_whole_json(spark, tmp_path):
    rows = reported(spark)
    found = whole(spark, documents.sarif_document(rows, "project", spark.createDataFrame([("F-2", "later")], "id string, reason string"), 'v"t'), tmp_path / "sarif")
    run = json.loads(found["p"])["runs"][0]
    assert run["tool"]["driver"]["name"] == 'v"t' and [r["id"] for r in run["tool"]["driver"]["rules"]] == ["CWE-89", "F-2"]
    assert [r["message"]["text"] for r in run["results"]] == ['a "quoted" <title>\n2', "SQL injection in getUser"] and [r["ruleIndex"] for r in run["results"]] == [0, 1]
    assert run["results"][0]["codeFlows"][0]["threadFlows"][0]["locations"][2]["message"]["text"] == "Sink: out" and run["results"][1]["suppressions"][0]["justification"] == "later"
    assert len(json.loads(found["q"])["runs"][0]["results"]) == 1
    notes = spark.createDataFrame([("p", "n", "line\ntwo"), ("z", "lost", "")], "project string, name string, content string")
    projects = spark.createDataFrame([("p", "/p"), ("empty", "/e")], "project string, path string")
    found = {k: json.loads(v) for k, v in whole(spark, documents.bundle_document(projects, notes, rows, ["a"]), tmp_path / "bundle").items()}
    assert found["p"]["memories"][0]["content"] == "line\ntwo" and [f["id"] for f in found["p"]["findings"]] == ["F-1", "F-2"] and found["p"]["finding_stats"]["by_severity"]["high"] == 1
    assert found["empty"] == {"project": {"project": "empty", "path": "/e"}, "memories": [], "findings": [], "finding_stats": {"total": 0, "by_severity": dict.fromkeys(("critical", "high", "medium", "low", "info"), 0), "by_status": found["empty"]["finding_stats"]["by_status"]}, "available_agents": ["a"]}
    assert documents.read_items(spark, f"file://{tmp_path}/sarif", "ruleId string", '{"ruleId"').count() == 3


def test_reports_have_all_there_is(spark, tmp_path):
    rows = reported(spark)
    text = whole(spark, documents.markdown_document(rows, "project"), tmp_path / "md")["p"]
    assert text.startswith("# Security Findings Report: p\n\nGenerated by vetta v1\n\n## Summary\n\n**Total Findings:** 2\n")
    assert "| 🟠 **HIGH** | 1 |\n| 🟢 **LOW** | 1 |\n" in text and "| open | 2 |" in text and text.count("\n---\n") == 2
    for part in ("#### Evidence\n\n1. **code:** seen\n   - Trace: a → b\n", "**Source:** in\n**Path:**\n1. s\n**Guards:**\n- g\n**Sink:** out\n**Verdict:** UNGUARDED\n", "```\nx()\n```\n", "#### Impact\n\nbad\n", "**File:** `a/b.py` (line 3)\n"):
        assert part in text
    html = {r["id"]: r["article"] for r in documents.html_articles(rows).collect()}
    assert "a &#34;quoted&#34; &lt;title&gt;" in html["F-1"] and "<p>what &amp; why</p>" in html["F-1"] and "<li>code: seen: a → b</li>" in html["F-1"] and "UNGUARDED" in html["F-1"]
    assert "<h3>Evidence" not in html["F-2"] + html["F-3"] and "<p>bad</p>" in html["F-2"]


def tree(spark, language, code):
    rows = text.lines(spark.createDataFrame([("f", code)], "path string, content string"))
    return [(r["name"], r["kind"], r["parent"], r["end_line"]) for r in text.symbol_tree(rows, language).orderBy("line_no").collect()]


def test_parents_of_symbols(spark):
    assert tree(spark, "python", "class A:\n  def m(self):\n    def inner():\n      pass\n\nX = 1\ndef f():\n  class B:\n    def n(self):\n      pass\n  def g():\n    pass") == [
        ("A", "class", None, 5), ("m", "method", "A", 5), ("inner", "method", "A", 5), ("f", "function", None, 12), ("B", "class", None, 10), ("n", "method", "B", 10), ("g", "function", None, 12)]
    assert tree(spark, "go", "type T struct {\n}\nfunc (t *T) M() {\n}\nfunc F() {\n}") == [("T", "struct", None, 2), ("M", "method", "T", 4), ("F", "function", None, 6)]
    assert tree(spark, "rust", "impl<'a> Show for Thing {\n  fn make() {\n  }\n}\nfn free() {\n}") == [("make", "method", "Thing", 3), ("free", "function", None, 6)]
    assert tree(spark, "ruby", "module M\n  class C\n    def x\n    end\n  end\nend\ndef y\nend") == [("M", "class", None, 6), ("C", "class", "M", 5), ("x", "method", "C", 4), ("y", "function", None, 8)]


def test_findings_against_their_files(spark):
    code = "q = request.args\nvalidate(q)\nrun(q)\nescape(q)\nrun(q)"
    rows = text.lines(spark.createDataFrame([("a", code), ("b", "run(1)"), ("c", "x = request.args"), ("d", "x = request.args\nrun(x)")], "path string, content string"))
    own = spark.createDataFrame([("1", "a", 2), ("2", "b", 1), ("3", "c", 1), ("4", "d", 40), ("5", "none", 1)], "id string, file string, line_start int")
    found = {r["id"]: (r["lines"], r["sources"], r["sinks"], r["guards"], r["verdict"], r["confidence"]) for r in flow.validate_against_code(own, rows, r"request\.", r"run\(").collect()}
    assert found == {"1": (5, 1, 2, 1, "uncertain_guard_present", "medium"), "2": (1, 0, 1, 0, "sink_present_source_missing", "low"), "3": (1, 1, 0, 0, "sink_missing", "low"), "4": (0, 1, 1, 0, "likely_true_positive", "high"), "5": (0, 0, 0, 0, "sink_missing", "low")}


def test_notes_of_many_blocks_are_searched_as_one(spark, monkeypatch):
    """Queries that have their best notes in the first block go to no other one; places are those of all notes scored one by one."""
    rand = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigmas", "kappa", "lambda"]
    made = [(f"n{k:03}", rand.choice(["one", "two"]), " ".join(rand.sample(words, rand.randint(1, 4)) + [f"own{k}"])) for k in range(160)]
    asks = [(q, " ".join(rand.sample([*words, "alphu", "betas", f"own{q}"], 3)), rand.choice([None, "one"])) for q in range(40)]
    monkeypatch.setattr(text, "NOTE_BLOCK", 20)
    monkeypatch.setattr(text, "QUERY_PART", 8)
    opened = []
    later = text.open_blocks
    monkeypatch.setattr(text, "open_blocks", lambda *a: opened.append(later(*a)) or opened[-1])
    index = text.index_notes(spark.createDataFrame(made, "name string, type string, content string"))
    found = text.search_note_table(index, spark.createDataFrame(asks, "query_id int, query string, type string"), 3).collect()
    stem = lambda w: re.sub("(ing|ed|es|s)$", "", w) if len(w) > 4 else w

    def near(a, b):
        less = lambda x, y: any(x[:k] + x[k + 1 :] == y for k in range(len(x)))
        return less(a, b) or less(b, a) or len(a) == len(b) and sum(x != y for x, y in zip(a, b)) < 2

    wanted = []
    for q, asked, kind in asks:
        scores = {}
        for word in {stem(w) for w in asked.split()}:
            hits = {}
            for name, t, content in made:
                held = {stem(w) for w in content.split()} | {name, t}
                if any(near(word, x) for x in held):
                    hits[name, t] = 1.0 if word in held else 0.5
            for note, w in hits.items():
                if kind in (None, note[1]):
                    scores[note] = scores.get(note, 0) + w * math.log(1 + len(made) / len(hits))
        best = sorted(scores, key=lambda n: (-round(scores[n], 9), n))[:3]
        wanted += [(q, *n, k + 1) for k, n in enumerate(best)]
    assert sorted((r["query_id"], r["name"], r["type"], r["place"]) for r in found) == sorted(wanted)
    assert 0 < opened[0].count() < 40 * 7
