"""Operators on small fixtures: goldens of ranking, graphs, registries, packing, rules, sources and snapshots."""

import json
import os
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeseam.functions import glob
from lodeseam.functions import text as T
from lodeseam.operators import audit, changes, extraction, graph, joins, packing, retrieval, substring, validation
from lodeseam.schema import as_cards
from lodeseam.session import Session, execute, retried
from lodeseam.sources import files, sinks
from lodeseam.streaming import incremental


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first().y


def cards_of(spark, rows):
    return as_cards(
        spark.createDataFrame(
            [(i, r, s, rel, n) for n, (i, r, s, rel) in enumerate(rows)], "id string, role string, search array<string>, rel array<string>, card_order long"
        )
    )


SESSION = [
    ("auth.session.rotate", "Rotate refresh tokens.", ["token rotation"], ["workflow>auth.session.revoke-family"]),
    ("auth.session.revoke-family", "Revoke a token family.", ["revoke tokens"], []),
    ("billing.credit.reserve", "Reserve credit once.", ["reserve credit"], []),
]


@pytest.mark.parametrize(("text", "tokens"), [("", 1), ("aaaa", 1), ("aaaaa", 2), ("\u0080" * 4, 3), ("한글", 2), ("😀", 2), ("abc한😀", 3)])
def test_token_estimates(spark, text, tokens):
    assert one(spark, T.approximate_tokens("x"), text) == tokens


def test_tokens_of_cjk_and_compatibility_forms(spark):
    assert one(spark, T.tokenize("x", composed=False), "Ｆｕｌｌ ﬁ 한국어") == ["full", "fi", "한국어", "한국", "국어", "한국어"]
    assert one(spark, T.normalize_search_text("x"), "  A b﻿") == "a b"
    assert sorted(one(spark, T.source_tokens("x"), "rotateToken")) == ["rotate", "rotatetoken", "token"]


def test_truncation_keeps_to_the_budget(spark):
    for text in ("short", "a" * 100, "한" * 50 + "a" * 50, "word " * 30):
        cut = one(spark, T.truncate_to_tokens("x", 10), text)
        assert one(spark, T.approximate_tokens("x"), cut) <= 10 and (cut == text or cut.endswith("…"))


@pytest.mark.parametrize(
    ("pattern", "path", "hit"),
    [
        ("*.ts", "a/b.ts", True), ("src/*.ts", "src/a/b.ts", False), ("src/**/*.ts", "src/b.ts", True), ("src/**/*.ts", "src/a/c/b.ts", True),
        ("?.ts", "ab.ts", False), ("src/**", "src/a/b", True), ("a.b", "axb", False), ("**/x", "x", True), ("lib", "src/lib", True), ("/lib", "src/lib", False),
    ],
)
def test_globs(spark, pattern, path, hit):
    assert one(spark, glob.matches_any("x", [pattern]), path) is hit


def test_ranking_goldens(spark):
    rows = [(f"{x}.seed", "s", [], [f"workflow>{x}.target"]) for x in "zyxa"] + [(f"{x}.target", "t", [], []) for x in "zyxa"]
    cards = cards_of(spark, rows)
    aliases = spark.createDataFrame([("find it", f"{x}.seed") for x in "zyxa"], "alias string, target string")
    q = spark.createDataFrame([(1, "please find it")], "query_id long, query string")
    got = [(r.id, r.score) for r in retrieval.query_cards(cards, q, aliases, top=10).orderBy("rank").collect()]
    assert got == [(f"{x}.seed", 500.0) for x in "axyz"] + [(f"{x}.target", 40.0) for x in "xyz"]


def test_contributions_add_up_in_their_order_wherever_they_come_from(spark):
    adds = [(1, 0.1), (2, 0.2), (3, 0.3)]
    rows = [(1, i, n, x, f"token=t{n}") for i, each in (("b", adds), ("a", adds[::-1])) for n, x in each]
    parts = spark.createDataFrame(rows, "query_id long, id string, ord int, score double, reason string").coalesce(1)
    got = {r.id: (r.score, r.reasons) for r in retrieval.summed(parts).collect()}
    assert got["a"] == got["b"] == (0.1 + 0.2 + 0.3, ["token=t1", "token=t2", "token=t3"])
    assert [r.id for r in retrieval.ranked(retrieval.summed(parts)).orderBy("rank").collect()] == ["a", "b"]


def test_ranks_by_rounded_scores(spark):
    scores = spark.createDataFrame([(1, "a", 0.3, []), (1, "b", 0.1 + 0.2, [])], "query_id long, id string, score double, reasons array<string>")
    ids = lambda df: [r.id for r in df.orderBy("rank").collect()]
    assert ids(retrieval.ranked(scores)) == ["b", "a"] and ids(retrieval.ranked(scores, digits=6)) == ["a", "b"]


def test_later_seeds_pass_on_what_earlier_ones_gave(spark):
    scores = spark.createDataFrame([(1, "a.a", 100.0, ["r"]), (1, "b.b", 50.0, ["r"])], "query_id long, id string, score double, reasons array<string>")
    edges = spark.createDataFrame([("a.a", "b.b", "k", 1.0), ("b.b", "c.c", "k", 0.5), ("a.a", "a.a", "k", 0.5)], "src string, dst string, kind string, confidence double")
    cards = cards_of(spark, [("a.a", "", [], []), ("b.b", "", [], []), ("c.c", "", [], [])])
    got = {r.id: r.score for r in retrieval.add_graph_bonus(scores, cards, edges).collect()}
    a, b = 100.0, 50.0
    b += a * 0.08
    a += a * 0.08 * 0.5 * 0.6
    a += a * 0.08 * 0.5
    held = {b}
    c = b * 0.08 * 0.5
    a += b * 0.08 * 0.6
    assert got["b.b"] == pytest.approx(b) and got["c.c"] == pytest.approx(c) and got["a.a"] == pytest.approx(a) and held


def test_session_answers(spark):
    cards = cards_of(spark, SESSION)
    registry = spark.createDataFrame(
        [("auth.old", "redirect", "auth.session.rotate", [], 1), ("auth.session.rotate", "active", None, [], 2)], "id string, state string, to string, by array<string>, line_no long"
    )
    s = Session(spark, cards, registry=registry)
    first = s.query("rotate token").orderBy("rank").first()
    assert first.id == "auth.session.rotate" and len(first.reasons) <= 6
    assert s.query("excludes: x").collect() == [] and s.query("zzz").collect() == []
    assert s.show("auth.old").first().status == "found" and s.show("no.such").first().status == "not_found"
    assert execute(s, "query", {"query": "reserve credit"})["rows"][0]["id"] == "billing.credit.reserve"
    assert [execute(s, *x)["code"] for x in (("nope", {}), ("show", {}), ("query", {"query": 1}))] == [404, 400, 400]
    assert execute(s, "context", {"id": "auth.session.rotate"})["rows"][0]["dst"] == "local/auth.session.revoke-family"
    assert not s.refresh(0, cards) and s.refresh(2, cards) and not s.refresh(1, cards)


def test_retried_reads():
    calls = []
    assert retried(lambda: calls.append(1) or 1 / (len(calls) - 1), pause=0) == 1.0
    with pytest.raises(RuntimeError):
        retried(lambda: 1 / 0, attempts=2, pause=0)


def test_substring_join_equals_a_product(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("ab ") for _ in range(rng.randint(0, 7))) for _ in range(60)]
    n = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "needle_id int, needle string")
    h = n.selectExpr("needle_id AS hay_id", "needle AS hay")
    got = {(r.needle_id, r.hay_id) for r in substring.substring_join(n, h).collect()}
    assert got == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if a and a in b}


def test_index_maintenance_equals_a_rebuild(spark):
    before = cards_of(spark, SESSION)
    after = cards_of(spark, [SESSION[0], ("auth.session.revoke-family", "Changed role", [], []), ("new.card.here", "New", [], [])])
    index, hashes = retrieval.maintain_postings(retrieval.postings(before), retrieval.document_hashes(before), after)
    row = lambda df: sorted(map(tuple, df.select("token", "id", "field", "tf").collect()))
    assert row(index) == row(retrieval.postings(after))
    assert {r.check: r.n for r in retrieval.index_violations(index, hashes, after).collect() if r.n} == {}
    assert {r.check for r in retrieval.index_violations(index, hashes, before).collect() if r.n} == {"unknown card", "changed card", "removed card"}
    assert retrieval.set_hash(hashes).first() == retrieval.set_hash(retrieval.document_hashes(after.repartition(3))).first()


def plain_context(root, edges, nodes, depth, max_edges):
    """First-in first-out search, node by node."""
    near = {}
    for e in edges:
        near.setdefault(e[1], []).append((-e[4], e[3], e[2], e[0]))
        near.setdefault(e[2], []).append((-e[4], e[3], e[1], e[0]))
    queue, visited, kept = [(root, 0)], set(), []
    while queue and len(kept) < max_edges:
        node, level = queue.pop(0)
        if node in visited or node not in nodes:
            continue
        visited.add(node)
        if level >= depth:
            continue
        for _, _, other, edge in sorted(near.get(node, [])):
            if len(kept) >= max_edges:
                break
            if edge not in kept:
                kept.append(edge)
            queue.append((other, level + 1))
    return set(kept)


@pytest.mark.parametrize("seed", range(6))
def test_bounded_context_equals_a_queue(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(8)]
    edges = [(f"e{k:02}", rng.choice(names), rng.choice(names), rng.choice("ab"), rng.choice((0.5, 1.0))) for k in range(rng.randint(3, 18))]
    nodes = set(names[: rng.randint(5, 8)])
    e = spark.createDataFrame(edges, "id string, src string, dst string, kind string, confidence double")
    n = spark.createDataFrame([(x,) for x in sorted(nodes)], "key string")
    roots = spark.createDataFrame([("n0",), ("n1",)], "root string")
    depth, most = rng.randint(0, 4), rng.randint(0, 10)
    got = {}
    for r in graph.bounded_context(roots, e, n, depth, most).collect():
        got.setdefault(r.root, set()).add(r.edge_id)
    for root in ("n0", "n1"):
        assert got.get(root, set()) == plain_context(root, edges, nodes, depth, most)


def test_registry_states(spark):
    rows = [
        ("a", "active", None, []), ("r", "redirect", "a", []), ("s", "replaced", None, ["r"]), ("m", "replaced", None, ["a", "r"]), ("t", "redirect", "m", []),
        ("c", "redirect", "d", []), ("d", "redirect", "c", []), ("e", "redirect", "c", []), ("x", "redirect", "gone", []), ("o", "retired", None, []),
    ] + [(f"l{i}", "redirect", f"l{i + 1}" if i < 60 else "a", []) for i in range(61)]
    reg = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "id string, state string, to string, by array<string>, line_no long")
    got = {r.id: (r.state, r.final_id) for r in graph.registry_resolution(reg).collect()}
    assert {k: got[k] for k in "arsmtcdexo"} == {
        "a": ("active", "a"), "r": ("active", "a"), "s": ("active", "a"), "m": ("ambiguous", "m"), "t": ("ambiguous", "m"),
        "c": ("cycle", None), "d": ("cycle", None), "e": ("cycle", None), "x": ("missing", "gone"), "o": ("retired", "o"),
    }
    assert got["l0"] == ("active", "a")
    assert {r.id for r in graph.cyclic_ids(reg).collect()} == {"c", "d", "e"}


def plain_cyclic(links):
    """Ids that can reach a cycle: what is left after peeling those whose targets are all acyclic."""
    left = dict(links)
    while gone := [i for i, to in left.items() if not any(t in left for t in to)]:
        for i in gone:
            del left[i]
    return set(left)


def test_registry_chains_of_thousands(spark):
    n = 3000
    rows = [(f"l{i}", "redirect", f"l{i + 1}" if i < n else "a", []) for i in range(n + 1)] + [("a", "active", None, [])]
    rows += [(f"k{i}", "redirect", f"k{i + 1}" if i < n else "k2990", []) for i in range(n + 1)]
    reg = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "id string, state string, to string, by array<string>, line_no long")
    got = {r.id: (r.state, r.final_id, r.steps) for r in graph.registry_resolution(reg).collect()}
    assert got["l0"] == ("active", "a", n + 1) and got["l2000"] == ("active", "a", n - 1999)
    assert {i for i, r in got.items() if r[0] == "cycle"} == {f"k{i}" for i in range(n + 1)} and len(got) == len(rows)


@pytest.mark.parametrize("seed", range(4))
def test_cycles_over_all_replacements(spark, seed):
    rng = random.Random(seed)
    rows = [("c", "redirect", "d", []), ("d", "redirect", "c", []), ("m", "replaced", None, ["a", "t"]), ("t", "redirect", "c", []), ("u", "redirect", "m", []), ("a", "active", None, [])]
    rows += [("v", "replaced", None, ["a", "w"]), ("w", "replaced", None, ["x", "v"]), ("y", "replaced", None, ["a", "gone"]), ("z", "redirect", "y", [])]
    names = [f"n{i}" for i in range(40)]
    for i, name in enumerate(names):
        far = names[i + 1 :] if rng.random() < 0.93 else names
        by = rng.sample(far, min(len(far), rng.randint(1, 3)))
        rows.append((name, "replaced", None, by) if by else (name, "active", None, []))
    reg = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "id string, state string, to string, by array<string>, line_no long")
    want = plain_cyclic({r[0]: [r[2]] if r[2] else r[3] for r in rows})
    assert {r.id for r in graph.cyclic_ids(reg).collect()} == want >= set("cdtmuvw") and not want & set("ayz")
    states = {r.id: (r.state, r.final_id) for r in graph.registry_resolution(reg).collect()}
    assert {i for i, s in states.items() if s[0] == "cycle"} == want and len(states) == len(rows)
    assert states["z"] == ("ambiguous", "y") and states["u"] == ("cycle", None)


def test_windows_and_packing(spark):
    content = "\n".join("hit" if i in (10, 20, 60) else "-" for i in range(1, 81))
    f = spark.createDataFrame([("a.ts", content)], "path string, content string")
    hits = packing.line_hits(f, spark.createDataFrame([("hit",)], "term string"))
    w = packing.source_windows(hits, f.selectExpr("path", "80 AS lines"))
    assert sorted((r["first"], r["last"], r.hits) for r in w.collect()) == [(2, 28, 2), (52, 68, 1)]
    items = spark.createDataFrame([(1, i, b) for i, b in enumerate((100, 5000, 50, 200))], "g int, o int, bytes long")
    assert sum(r.used for r in packing.pack_with_quota(items, "g", "o", 700).collect()) <= 700
    with pytest.raises(ValueError):
        packing.page(items, "g", ["o"], 0, 0, 10)


BLOCK = """/* card symbol
 * id=auth.session.rotate
 * role=Rotate tokens.
 * search=token rotation | session
 * rel=test>auth.session.test
 * stability=contract
 */
export function rotate(x) {}
# card file
# role=handles things
# id=Bad Id
# colour=red
# /card
<!-- card module
id=a.b
oops
"""


def test_blocks_cards_and_rules(spark):
    f = spark.createDataFrame([("src/a.ts", BLOCK), ("src/b.ts", "no marks")], "path string, content string")
    found = extraction.blocks(f).cache()
    assert [(r.scope, r.style, len(r.entries)) for r in found.orderBy("block_no").collect()] == [("symbol", "block", 5), ("file", "line", 3), ("module", "html", 1)]
    card = extraction.cards_of(found).orderBy("block_no").first()
    assert (card.id, card.search, card.rel, card.stability) == ("auth.session.rotate", ["token rotation", "session"], ["test>auth.session.test"], "contract")
    codes = sorted((r.code, r.line) for r in validation.block_diagnostics(found).collect())
    assert ("C005", 12) in codes and ("C010", 9) in codes and ("C011", 16) in codes and ("C001", 9) in codes and not [c for c in codes if c[1] < 9]
    text = extraction.canonical_text(found).where("block_no = 1").first().canonical
    assert text.split("\n")[0] == "id=Bad Id"
    assert [(r.symbol, r.exported) for r in extraction.declarations(f).collect()] == [("rotate", True)]


def test_card_rules(spark):
    good = dict(id="a.b", role="Keeps money safe for every tenant always.", search=["x y", "z w"], risk=["money"], invariant=["never twice"], rel=["test>a.c"], effect=["fs.read", "db.read(t)"], stability="contract")
    bad = {
        "C001": dict(invariant=[]), "C002": dict(id="A"), "C003": dict(role="See src/a.ts line 3 for the details of it."), "C004": dict(rel=["calls>a.c", "test>a.c"]),
        "C005": dict(effect=["fs.read(x)"]), "C006": dict(role="x" * 181), "C007": dict(search=["only one"]), "C013": dict(invariant=list("abcde")),
    }
    schema = "id string, role string, search array<string>, risk array<string>, invariant array<string>, rel array<string>, effect array<string>, stability string, card_order long"
    rows = lambda over: [tuple((good | over)[k] for k in ("id", "role", "search", "risk", "invariant", "rel", "effect", "stability")) + (1,)]
    codes = lambda over: {r.code for r in validation.card_diagnostics(spark.createDataFrame(rows(over), schema)).collect()}
    assert codes({}) == set()
    for code, over in bad.items():
        assert codes(over) == {code}, code


def test_imports_boundaries_and_barrels(spark):
    js = 'import a from "./a";\nimport "x";\nconst y = require("./y");\nexport * from "./z";\n'
    f = spark.createDataFrame([("src/a.ts", js), ("api/m.py", "from .a import b\nimport os.path\n"), ("cmd/main.go", 'package main\nimport (\n\t"fmt"\n)\n'), ("i.ts", 'export * from "./b";\n// c\n')], "path string, content string")
    got = {r.path: r for r in f.select("path", extraction.imports(F.col("path"), F.col("content")).alias("i"), extraction.boundaries(F.col("path"), F.col("content")).alias("b"), extraction.is_barrel(F.col("content")).alias("x")).collect()}
    assert got["src/a.ts"].i == ["./a", "./y", "./z", "x"] and got["api/m.py"].i == [".a", "os.path"] and got["cmd/main.go"].i == ["fmt"]
    assert [b.kind for b in got["cmd/main.go"].b] == ["command"] and [b.kind for b in got["api/m.py"].b] == ["route"]
    assert [got[p].x for p in ("i.ts", "src/a.ts")] == [True, False]
    files_ = spark.createDataFrame([("src/a.ts",), ("src/y/index.ts",), ("z.ts",), ("z.js",)], "path string")
    asked = spark.createDataFrame([("src/b.ts", "./a"), ("src/b.ts", "../z"), ("src/b.ts", "./y")], "src_path string, specifier string")
    hits = {(r.specifier, r.dst_path) for r in joins.resolve_imports(asked, files_, [".ts", ".js", "/index.ts"], True).collect()}
    assert hits == {("./a", "src/a.ts"), ("../z", "z.ts"), ("./y", "src/y/index.ts")}


def test_audit(spark):
    f = spark.createDataFrame(
        [("src/index.ts", "export * from './lib';\nexport const a = 1;\n"), ("src/lib.ts", "export function f() {}\n"), ("api/r.ts", "export const r = 1;\n"), ("tests/t.test.ts", "export const t = 1;\n"), ("src/utils.ts", "export const u = 1;\n"), ("src/done.ts", "export const d = 1;\n")],
        "path string, content string",
    )
    paths = lambda *x: spark.createDataFrame([(p,) for p in x], "path string")
    links = spark.createDataFrame([("src/index.ts", "src/lib.ts"), ("api/r.ts", "src/lib.ts")], "src_path string, dst_path string")
    covered = spark.createDataFrame([("src/done.ts", "file")], "path string, scope string")
    reasons = spark.createDataFrame([("api/r.ts", "known"), ("gone.ts", "x"), ("src/done.ts", "y")], "path string, reason string")
    found, state = audit.audit(f, links, paths("src/index.ts"), links.toDF("src", "dst").limit(1), covered, reasons)
    got = {r.path: (r.score, r.priority) for r in found.collect()}
    assert got["src/index.ts"] == (60, "high") and got["src/lib.ts"][0] == 45 + 10 + 10 and "src/utils.ts" not in got and "api/r.ts" not in got and "src/done.ts" not in got
    assert {(r.path, r.status, r.reason) for r in state.collect()} == {("api/r.ts", "suppressed", "known"), ("gone.ts", "stale", "file-not-scanned"), ("src/done.ts", "stale", "already-carded")}
    assert [r.path for r in audit.ranked_candidates(found, "high", 1).collect()] == ["src/lib.ts"] and audit.audit_summary(found).first().candidates == len(got)
    every, _ = audit.audit(f, links, paths("src/index.ts"), links.toDF("src", "dst").limit(1), covered)
    status = {r.path: r.status for r in audit.explain_files(f, covered, every, reasons).collect()}
    assert status["gone.ts"] == "stale" and status["api/r.ts"] == "suppressed" and status["src/lib.ts"] == "candidate" and status["src/utils.ts"] == "not-candidate"


def test_sources(spark, tmp_path):
    for name, text in {"a.ts": "x", "_p/b.ts": "y", ".git/c.ts": "z", "d.min.ts": "q", "e.py": "w"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = files.scan_files(spark, str(tmp_path), [".ts"], ["*.min.ts"]).collect()
    assert sorted((r.path, r.content, r.source_bytes) for r in got) == [("_p/b.ts", "y", 1), ("a.ts", "x", 1)]
    with pytest.raises(Exception, match="over 0 bytes"):
        files.scan_files(spark, str(tmp_path), [".ts"], limit=0).collect()
    reg = tmp_path / "r.jsonl"
    reg.write_text("# c\n\n" + "\n".join([json.dumps(dict(id="a.b", state="active")), "nope", json.dumps(dict(id="c.d", state="redirect")), json.dumps(dict(state="replaced", by=["a.b"], id="e.f"))]))
    good, bad = files.read_registry(spark, str(reg))
    assert [(r.id, r.line_no) for r in good.orderBy("line_no").collect()] == [("a.b", 3), ("e.f", 6)]
    assert [(r.line_no, r.message) for r in bad.orderBy("line_no").collect()] == [(4, "invalid JSON"), (5, "redirect without target")]
    g = tmp_path / "g.json"
    g.write_text(json.dumps({"schemaVersion": 1, "repositoryId": "r", "definitions": [{"id": "a", "symbol": "s", "path": "p"}], "references": [{"from": "a", "to": "o/b", "kind": "calls"}]}))
    d, r = files.read_graph_input(spark, str(g))
    assert d.first().id == "r/a" and tuple(r.first()) == ("r/a", "o/b", "calls", None, None, 0.8)
    assert files.deep_merge({"a": {"b": 1, "c": [1]}, "d": 2}, {"a": {"c": [2]}}) == {"a": {"b": 1, "c": [2]}, "d": 2}
    assert files.manifest_entrypoints(json.dumps(dict(main="./a.js", exports={".": dict(types="./t.d.ts", default="./b.js")}))) == ["a.js", "b.js"]


def test_snapshots_and_stream(spark, tmp_path):
    root, source = str(tmp_path / "snap"), str(tmp_path / "in")
    cards_of(spark, SESSION).write.parquet(source)
    incremental.maintain(spark, source, root, str(tmp_path / "cp")).awaitTermination()
    assert sinks.open_snapshot(spark, root)["cards"].count() == 3 and sinks.manifest_violations(spark, root) == []
    held = sinks.open_snapshot(spark, root)
    feed = incremental.apply_batch(spark, root, cards_of(spark, [("new.card.x", "New", [], []), ("billing.credit.reserve", None, [], [])]))
    assert {(r.id, r.change) for r in feed.collect()} == {("new.card.x", "added"), ("billing.credit.reserve", "removed")}
    assert held["cards"].count() == 3 and Session.from_snapshot(spark, root).query("new").first().id == "new.card.x"
    assert incremental.apply_batch(spark, root, cards_of(spark, [("new.card.x", "New", [], [])])).collect() == []
    with sinks.generation_lock(root), pytest.raises(TimeoutError), sinks.generation_lock(root, timeout=0.1):
        pass
    name = sinks.write_receipt(str(tmp_path / "rec"), {"b": 1, "a": 2})
    assert sinks.write_receipt(str(tmp_path / "rec"), {"a": 2, "b": 1}) == name and os.listdir(tmp_path / "rec") == [f"{name}.json"]


def test_diagnostic_forms(spark):
    d = spark.createDataFrame([("error", "C001", "m%\n", "a b.ts", 3, 2), ("warning", "C002", "n", "a.ts", 1, 1)], "severity string, code string, message string, file string, line int, column int")
    sarif = json.loads(sinks.diagnostics_to_sarif(d))
    assert [r["ruleId"] for r in sarif["runs"][0]["results"]] == ["C001", "C002"] and "a%20b.ts" in json.dumps(sarif)
    assert {r.file: r["items"][0].line for r in sinks.diagnostics_to_editor(d).collect()} == {"a b.ts": 2, "a.ts": 0}
    assert "::error file=a b.ts,line=3,col=2,title=C001::m%25%0A" in [r.out for r in sinks.diagnostics_to_lines(d, "github").collect()]
    assert {r.severity: r.n for r in validation.diagnostic_counts(d).collect()} == {"error": 1, "warning": 1, "info": 0}


def test_gates(spark):
    m = lambda n, a, b: spark.createDataFrame([(n, a, b, 0.5, 0, 0)], "cases long, recall_at_1 double, recall_at_5 double, mrr double, negatives long, negatives_passed long")
    status = lambda *x, k=1: retrieval.gate_status(m(*x), k).first().status
    assert [status(0, 0.0, 0.0), status(3, 0.8, 0.95), status(3, 0.7, 0.95), status(3, 0.8, 0.95, k=5)] == ["unmeasured", "passed", "failed", "insufficient"]


def test_receipts_and_inputs(spark):
    r = spark.createDataFrame([("1", {"a": "x"}), ("2", {"a": "y"}), ("3", {})], "id string, files map<string,string>")
    now = spark.createDataFrame([("a", "x")], "path string, hash string")
    assert {x.id: x.status for x in sinks.receipt_status(r, now).collect()} == {"1": "matches", "2": "stale", "3": "unknown"}
    a, b = spark.createDataFrame([("p", "1"), ("q", "1")], "path string, content_hash string"), spark.createDataFrame([("p", "2"), ("s", "1")], "path string, content_hash string")
    assert {(x.path, x.problem) for x in changes.input_mismatches(a, b).collect()} == {("p", "changed"), ("q", "missing"), ("s", "unexpected")}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "*", "**", "?", "b.c"]), min_size=1, max_size=5))
def test_globs_compile(parts):
    import re

    re.compile(glob.glob_regex("/".join(parts)))


def test_each_sign_of_a_boundary(spark):
    rows = [
        ("a.ts", "export async function cacheFileName() { return `x.index.json` }", [("artifact", "medium", ["persistent-json-filename"])]),
        ("Bin/x.py", "", [("command", "high", ["path"])]),
        ("a/initCommand.js", "", [("command", "high", ["path"])]),
        ("main.go", "// x\npackage main\n", [("command", "high", ["path"])]),
        ("main.go", "package mainly", []),
        ("src/bin/a.rs", "#[tauri::command]", [("command", "high", ["path", "tauri-command"])]),
        ("a.rs", "#[cfg(unix)] impl Drop for X", [("runtime", "medium", ["platform-lifecycle"])]),
        ("a.tsx", "getTauriInvoke (); invoke<string>(x)", [("command", "high", ["tauri-invoke"])]),
        ("events/a.go", None, [("event", "medium", ["path"])]),
        ("db/migrate/a.py", "", [("migration", "high", ["path"])]),
        ("api/schema.yaml", "", [("route", "high", ["path"]), ("schema", "high", ["path"])]),
        ("a.py", "schemaVersion: 'card/v1.2'", [("schema", "high", ["versioned-schema-literal"])]),
        ("apis/a.py", "x", []),
    ]
    f = spark.createDataFrame([(i, p, s) for i, (p, s, _) in enumerate(rows)], "i int, path string, content string")
    got = f.select("i", extraction.boundaries(F.col("path"), F.col("content")).alias("b")).collect()
    assert {r.i: [(b.kind, b.confidence, b.evidence) for b in r.b] for r in got} == {i: w for i, (_, _, w) in enumerate(rows)}
    stated = extraction.boundaries(F.lit("events/migrate/a.py"), F.lit(""), F.array(F.lit("event.emit(x)")), F.array(F.lit("migration")))
    assert [tuple(b) for b in spark.range(1).select(stated.alias("b")).first().b] == [("event", "high", ["effect"]), ("migration", "high", ["risk"])]


def test_rust_paths(spark):
    files_ = spark.createDataFrame([(p,) for p in ("k/src/a.rs", "k/src/a/b.rs", "k/src/a/mod.rs", "k/src/c/mod.rs", "k/src/c/d.rs", "x/y.rs", "x/lib.rs")], "path string")
    asked = [
        ("k/src/c/d.rs", "crate::a", "k/src/a.rs"), ("k/src/c/d.rs", "super::super::a::b", "k/src/a/b.rs"), ("k/src/c/d.rs", "super::d", "k/src/c/d.rs"), ("k/src/c/mod.rs", "super::a::b as z", "k/src/a/b.rs"),
        ("k/src/c/mod.rs", "self::d::{X, Y}", "k/src/c/d.rs"), ("k/src/lib.rs", "c", "k/src/c/mod.rs"), ("x/lib.rs", "crate::y::*", "x/y.rs"), ("x/lib.rs", "crate", None), ("x/lib.rs", "(y)", None), ("k/src/a.rs", "b", "k/src/a/b.rs"),
    ]
    got = joins.resolve_rust_paths(spark.createDataFrame([a[:2] for a in asked], "src_path string, specifier string"), files_).collect()
    assert {(r.src_path, r.specifier, r.dst_path) for r in got} == {a for a in asked if a[2]}


def test_shared_budget(spark):
    texts = ["abc\r\nd", "äöü" * 5, None, "xyz", "q" * 40]
    rows = spark.createDataFrame([(r, k, t) for r in (1, 2) for k, t in enumerate(texts) if r == 1 or k > 1], "request int, rank int, text string")
    for budget in (0, 3, 6, 7, 13, 22, 30, 100):
        want = []
        for request in (1, 2):
            left = budget
            for k, t in enumerate(texts):
                if t is None or not left or request == 2 and k < 2:
                    continue
                t, out = t.replace("\r\n", "\n"), ""
                for c in t:
                    if len((out + c).encode()) > left:
                        break
                    out += c
                left -= len(out.encode())
                want.append((request, k, out, out != t))
        assert sorted(tuple(r) for r in packing.shared_budget(rows, budget).collect()) == want


def test_affected_catalogs(spark):
    known = spark.createDataFrame([("c/repo.txt", "repository", "repository"), ("c/m/a.txt", "module", "a"), ("c/m/a.txt", "module", "a"), ("c/m/b.txt", "module", "b")], "file string, kind string, id string")
    changed = spark.createDataFrame([("c\\m\\a.txt",), ("c/repo.txt",), ("c/repo.txt",), ("src/a.ts",)], "path string")
    assert sorted(tuple(r) for r in changes.affected_catalogs(changed, known).collect()) == [("c/m/a.txt", "module", "a"), ("c/repo.txt", "repository", "repository")]


def test_declared_context_counts_each_step(spark):
    rng = random.Random(6)
    rels = {f"c{i}": [f"policy>c{rng.randrange(34)}" for _ in range(rng.randrange(4))] for i in range(30)}
    cards = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(rels.items())], "id string, rel array<string>, card_order int")
    roots = spark.createDataFrame([(f"c{i}",) for i in (0, 1, 2, 33)], "root string")
    for depth, most in ((0, 9), (2, 0), (1, 2), (3, 7), (4, 12), (6, 1000)):
        want = {}
        for root in ("c0", "c1", "c2"):
            queue, seen, out, steps = [(root, 0)], set(), [], 0
            for node, level in queue:
                if node in seen or node not in rels:
                    continue
                seen.add(node)
                out.append((level, node))
                if level < depth:
                    near = [r.split(">")[1] for r in rels[node]] + [k for k, v in rels.items() for r in v if r.split(">")[1] == node]
                    near = near[: most - steps]
                    steps += len(near)
                    queue += [(n, level + 1) for n in near]
            want[root] = out
        got = {}
        for r in graph.declared_context(roots, cards, depth, most).orderBy("root", "level", "pos").collect():
            got.setdefault(r.root, []).append((r.level, r.id))
        assert got == want


def test_reachable_at_any_distance(spark):
    chain = [(i, i + 1) for i in range(70)] + [(70, 35), (70, 70), (None, 5), (3, None), (500, 501), (70, 0)]
    links = spark.createDataFrame(chain + chain[:5], "src long, dst long")
    start = spark.createDataFrame([(0,), (0,), (None,), (900,)], "node long")
    assert sorted(r.node for r in graph.reachable(start, links).collect()) == [*range(71), 900]
    assert graph.reachable(start.where("false"), links).collect() == []


def broadcast_parts(df):
    """The parts of the plan of df that are broadcast, as text."""
    lines, out = df._jdf.queryExecution().sparkPlan().toString().splitlines(), []
    depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
    for k, line in enumerate(lines):
        if "Join" in line and ("BuildRight" in line or "BuildLeft" in line):
            below = [n for n in range(k + 1, len(lines)) if depth(lines[n]) == depth(line) + 3][:2]
            at = below[1] if "BuildRight" in line else below[0]
            end = next((n for n in range(at + 1, len(lines)) if depth(lines[n]) <= depth(lines[at])), len(lines))
            out.append("\n".join(lines[at:end]))
    return out


@pytest.mark.parametrize("few", (0, 100))
def test_haystacks_are_never_broadcast(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(substring, "FEW", few, raising=False)
    spark.range(3000).selectExpr("id AS hay_id", "'one hay like all the others' AS hay").write.parquet(str(tmp_path / "hay"))
    needles = spark.createDataFrame([(1, "like"), (2, "e"), (3, "none"), (4, "")], "needle_id int, needle string")
    df = substring.substring_join(needles, spark.read.parquet(str(tmp_path / "hay")))
    assert not [p for p in broadcast_parts(df) if "hay_id" in p]
    assert {(r.needle_id, r["count"]) for r in df.groupBy("needle_id").count().collect()} == {(1, 3000), (2, 3000)}


def test_scores_never_broadcast_cards(spark, tmp_path):
    rows = spark.range(3000).selectExpr("'c.x' || id AS id", "'red ring' AS role", "id AS card_order", "array('workflow>c.x0') AS rel")
    rows.write.parquet(str(tmp_path / "cards"))
    cards = as_cards(spark.read.parquet(str(tmp_path / "cards")))
    q = spark.createDataFrame([(1, "red"), (2, "c.x7")], "query_id long, query string")
    parts = retrieval.score_parts(cards, q, spark.createDataFrame([("red", "c.x1")], "alias string, target string"))
    assert not [p for p in broadcast_parts(parts) if re.search("parquet", p) and "LocalTableScan" not in p and "ExistingRDD" not in p and "Aggregate" not in p]
    assert parts.groupBy("query_id").count().count() == 2


@pytest.mark.parametrize("given", (False, True))
def test_bonuses_never_broadcast_cards_or_edges(spark, tmp_path, given):
    spark.range(3000).selectExpr("'c.x' || id AS id", "'red ring' AS role", "id AS card_order", "array('workflow>c.x0') AS rel").write.parquet(str(tmp_path / "cards"))
    cards = as_cards(spark.read.parquet(str(tmp_path / "cards")))
    edges = cards.selectExpr("id AS src", "'c.x' || card_order % 1 AS dst", "'next' AS kind", "0.5D AS confidence") if given else retrieval.relation_edges(cards)
    scores = spark.createDataFrame([(1, "c.x7", 9.0, ["r"]), (1, "c.x8", 8.0, ["r"])], "query_id long, id string, score double, reasons array<string>")
    out = retrieval.add_graph_bonus(scores, cards, edges)
    assert not [p for p in broadcast_parts(out) if "parquet" in p]
    assert sorted(r.id for r in out.collect()) == ["c.x0", "c.x7", "c.x8"]


def test_declared_context_without_a_limit(spark):
    rows = [("r", [], -2), ("n", ["policy>r"], -1)] + [(f"s{i}", ["policy>n"], i) for i in range(1100)]
    cards = spark.createDataFrame(rows, "id string, rel array<string>, card_order int")
    roots = spark.createDataFrame([("s0",), ("s1099",)], "root string")
    got = {(r.root, r.level): r["count"] for r in graph.declared_context(roots, cards, 3, None).groupBy("root", "level").count().collect()}
    assert got == {(root, level): n for root in ("s0", "s1099") for level, n in ((0, 1), (1, 1), (2, 1100))}


def test_tasks_of_postings_hold_a_bounded_number_of_cards(spark):
    cards = spark.range(110_000).selectExpr("'c.x' || id AS id", "'red red ring' AS role", "id AS card_order").coalesce(1)
    index = retrieval.postings(as_cards(cards))
    assert index.rdd.getNumPartitions() == 6
    assert {(r.token, r.tf) for r in index.where("field = 'role'").select("token", "tf").distinct().collect()} == {("red", 2), ("ring", 1)}
