"""Golden cases of the core operators."""

import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.functions.embed import hashing_embedder
from sparkloom.functions.vectors import cosine
from sparkloom.operators import caches, compress, export, extract, graph, history, links, maintenance, memory, paths, privacy, ranges, retrieval, splitters, symbols
from sparkloom.plans.index import index_documents
from sparkloom.sources import loaders


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "masked"),
    [
        ("john@example.com", "j***@example.com"), ("a@b.com", "***@b.com"), ("13812345678", "138****5678"), ("192.168.1.77", "192.168.**.**"),
        ("123-45-6789", "123-**-6789"), ("000-12-3456", "000-12-3456"), ("E12345678", "E****5678"), ("", ""), ("x 4111111111111111 y", "x 4111****1111 y"),
    ],
)
def test_masks(text, masked):
    assert privacy.redact(text) == masked


def test_redact_in_frames(spark):
    df = spark.createDataFrame([(1, "mail john@example.com"), (2, None), (3, "")], "k long, t string")
    got = {r.id: (r.text, r.detections) for r in privacy.redacted(df, "k", "t").collect()}
    assert got == {1: ("mail j***@example.com", 1), 2: (None, 0), 3: ("", 0)}
    assert one(spark, privacy.masked_emails(F.lit("x a@b.com, jo@c.org"))) == "x ***@b.com, j***@c.org"


def test_entities(spark):
    found = one(spark, extract.entities(F.lit("The HashMap uses HTTP_STATUS codes. fetchData returns JSON. Upgrade to v2.0.0. Server at 192.168.1.1 gives 404 on 2024-01-05")))
    kinds = {e.entity: e.type for e in found}
    assert {k: kinds[k] for k in ("HashMap", "HTTP_STATUS", "fetchData", "JSON", "v2.0.0", "192.168.1.1", "404", "2024-01-05", "Server")} == {
        "HashMap": "tech_term", "HTTP_STATUS": "tech_term", "fetchData": "tech_term", "JSON": "tech_term", "v2.0.0": "identifier",
        "192.168.1.1": "identifier", "404": "identifier", "2024-01-05": "date", "Server": "proper_noun",
    }
    assert "The" not in kinds and one(spark, extract.entities(F.lit(""))) == []
    texts = ["张三今天完成了代码审查，李明也提交了 PR。", "应该由她来做", "", None, "王", "张三张三"]
    found = [r.p for r in spark.createDataFrame([(t,) for t in texts], "t string").select(extract.persons(F.col("t")).alias("p")).collect()]
    assert found == [["张三", "李明"], [], [], None, [], ["张三"]]
    more = spark.createDataFrame([("应该由", ), ("应小由", )], "t string").select(extract.persons(F.col("t"), "应").alias("p")).collect()
    assert [r.p for r in more] == [["应该由"], ["应小"]]


def test_relations():
    assert extract.relation_of("Rust is defined as Cargo", "Rust", "Cargo") == ("defined_as", 1.0)
    assert extract.relation_of("HashMap 依赖 Rust 标准库", "HashMap", "Rust") == ("depends_on", 1.0)
    assert extract.relation_of("Kafka relies on Zookeeper", "Kafka", "Zookeeper") == ("depends_on", 0.7)
    assert extract.relation_of("Kafka and Flink", "Kafka", "Flink") == ("related_to", 0.5)
    assert extract.relation_of("Kafka " + "x" * 200 + " Flink", "Kafka", "Flink") is None


def test_links_propositions_symbols():
    assert extract.wiki_links("see [[A|x]] and [[B#h]] `[[C]]` [[A]]\n```\n[[D]]\n```\n[[E]]") == ["A", "B", "E"]
    assert extract.propositions("Rust is fast. It is safe. However nobody knows.", lambda s: "Rust" if "Rust" in s else None) == ["Rust is fast.", "Rust is safe.", "Rust: However nobody knows."]
    code = "import x\n\ndef f(a):\n    return a\n\nclass C:\n    def m(self):\n        pass\n"
    assert [(n, k) for n, k, *_ in extract.code_symbols(code, "python")] == [("f", "function"), ("C", "class"), ("m", "method")]
    assert splitters.symbol_split(code, extract.code_symbols(code, "python"))[1].startswith("// Symbol: f (function)\ndef f(a):")


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=3000), st.integers(8, 64))
def test_splitters_keep_words_and_sizes(text, window):
    for kind in ("paragraph", "semantic", "section"):
        parts = splitters.SPLITTERS[kind](text, window, 2)
        assert all(p.encode("utf-8", "replace") for p in parts)
        assert bool(parts) <= bool(text.strip())
    assert len(splitters.window_split(text, 2 * window, 2)) <= len(splitters.window_split(text, window, 2))


def test_splitters():
    with pytest.raises(ValueError):
        splitters.semantic_split("x", 0, 0)
    with pytest.raises(ValueError):
        splitters.semantic_split("x", 8, 8)
    assert splitters.section_split("# A\n\none\n\n## B\n\ntwo", 64, 8) == ["[A] A\n\none", "[A > B] B\n\ntwo"]
    assert splitters.code_segments("a\n```py\nx=1\n```\nb") == [("prose", "a\n"), ("code", "x=1\n"), ("prose", "b")]


def test_scalar_functions(spark):
    assert one(spark, T.normalize_query(F.lit("  What   IS\tit "))) == "what is it"
    assert one(spark, T.fts_query(F.lit("tokio tokio tokio"))) == '"tokio"' and one(spark, T.fts_query(F.lit("   "))) == ""
    assert one(spark, T.fts_query(F.lit("分布式系统"))) == '"分布式" OR "布式系" OR "式系统"'
    assert one(spark, T.similarity(F.lit(""), F.lit(""))) == 1.0 and one(spark, T.similarity(F.lit("a"), F.lit(""))) == 0.0
    assert one(spark, T.ssn_is_valid(F.lit("000-12-3456"))) is False and one(spark, T.card_is_valid(F.lit("4111111111111112"))) is False
    assert one(spark, T.condition_holds("length>3", F.lit("abcd"))) and one(spark, T.condition_holds("contains:B", F.lit("abc")))
    assert one(spark, T.safe_file_name(F.lit(" a/b:c. "))) == "a_b_c" and one(spark, T.safe_file_name(F.lit(".."))) == "conversation"
    assert one(spark, T.xml_escape(F.lit('<a & "b">'))) == "&lt;a &amp; &quot;b&quot;&gt;"
    assert one(spark, cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    assert one(spark, cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0)), "prefix")) == 1.0


def test_graph(spark):
    e = spark.createDataFrame([("A", "B"), ("B", "C"), ("X", "Y"), ("A", "A"), (None, "B")], "src string, dst string")
    assert graph.shortest_path(e, "A", "C") == ["A", "B", "C"] and graph.shortest_path(e, "A", "A") == ["A"] and graph.shortest_path(e, "Q", "A") == []
    assert graph.shortest_path(e, "A", "Y") == []
    assert {r.node: r.component for r in graph.components(e).collect()} == {"A": "A", "B": "A", "C": "A", "X": "X", "Y": "X"}
    star = spark.createDataFrame([("A", x) for x in "BCD"], "src string, dst string")
    assert {r.node: r.centrality for r in graph.degree_centrality(star).collect()}["A"] == 1.0
    assert [r.path for r in graph.simple_paths(e, "A", "C").collect()] == [["A", "B", "C"]]


def test_pointer_jumping(spark):
    rows = [(i, i - 1 if i else None, 2) for i in range(40)] + [(100, 101, 1), (101, 102, 1), (102, 100, 1), (103, 100, 1), (200, 999, 1), (201, 200, 1), (None, 1, 1)]
    got = {r.id: r for r in paths.resolve_paths(spark.createDataFrame(rows, "id long, parent long, w long"), weight_col="w").collect()}
    assert [(got[i].root, got[i].before, got[i].state) for i in (0, 1, 39)] == [(0, 0, "ok"), (0, 2, "ok"), (0, 78, "ok")]
    assert {got[i].state for i in (100, 101, 102, 103)} == {"cycle"} and (got[201].state, got[201].root) == ("orphan", 999)
    assert paths.resolve_paths(spark.createDataFrame([], "id long, parent long")).count() == 0


def test_fusion_and_gate(spark):
    v = spark.createDataFrame([(1, 0.9, 0), (2, 0.8, 1)], "id long, score double, rank long")
    k = spark.createDataFrame([(3, 9.0, 0), (2, 8.0, 1)], "id long, score double, rank long")
    got = retrieval.fuse({"vector": v, "keyword": k}, 10).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [(2, 0.8), (1, 0.9), (3, 9.0)]
    assert retrieval.fuse({"vector": v}, 0).count() == 0


def test_history_and_memory(spark):
    m = spark.createDataFrame([(1, i, "Action: go" if i == 2 else "x", "assistant" if i % 2 == 0 else "user") for i in range(1, 5)], "c long, n long, content string, role string")
    assert [r.n for r in history.newest_within_budget(m, "c", ["n"], F.lit(10), 25).orderBy("n").collect()] == [3, 4]
    assert history.newest_within_budget(m, "c", ["n"], F.lit(10), 1).count() == 1
    assert history.repair_observations(m, "c", ["n"]).count() == 5
    assert one(spark, maintenance.apply_feedback(F.lit(0.9), F.array(F.lit("up"), F.lit("down")))) == 0.75
    assert maintenance.layers(["a", "b", "c"], [("a", "b"), ("b", "c")]) == [["a"], ["b"], ["c"]]
    with pytest.raises(ValueError):
        maintenance.layers(["a", "b"], [("a", "b"), ("b", "a")])
    got = one(spark, maintenance.scratch_commands(F.lit("UPDATE 2: new\nDELETE 3\nADD: more\nnoise")))
    assert [(c.command, c.number, c.content) for c in got] == [("update", 2, "new"), ("delete", 3, ""), ("add", None, "more")]
    assert [x.kind for x in one(spark, maintenance.memory_lines(F.lit("[Fact] a\nno\n[pref] b")))] == ["fact", "pref"]


def test_prompt(spark):
    h = spark.createDataFrame([(1, 0, "d", "text", 3, 0.5)], "q long, rank long, doc_name string, content string, sequence int, score double")
    assert export.rag_prompt(h, "q").first().prompt == "[1] 来源《d》：\ntext\n\n"
    assert export.citations(h, "q").first().citations == "1. **d** (chunk #3, score: 0.50)\n"


def _zip(files):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return b.getvalue()


def test_loaders():
    assert loaders.csv_text(b"a;b;c\n1;2\n\n3;4;5;6\n") == "| a | b | c |\n| --- | --- | --- |\n| 1 | 2 |  |\n| 3 | 4 | 5 |"
    assert loaders.html_text(b"<nav>x</nav><h1>T <b>x</b></h1><p>a &amp; b</p><ul><li>one</li></ul><script>q</script>") == "# T x\n\na & b\n\n- one"
    assert loaders.markdown_text("# T\n\n**b** [l](u)\n\n\n\n- i".encode()) == "T\n\nb l\n\ni"
    assert loaders.decode(b"a\xff") == "a�"
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    doc = f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>h</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    assert loaders.docx_text(_zip({"word/document.xml": doc})) == "a\tb\n\n| h |\n| --- |"
    sheet = '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2.0</v></c></row></sheetData></worksheet>'
    x = _zip({"xl/workbook.xml": '<workbook><sheets><sheet name="S"/></sheets></workbook>', "xl/sharedStrings.xml": "<sst><si><t>h</t></si></sst>", "xl/worksheets/sheet1.xml": sheet})
    assert loaders.xlsx_text(x) == "## S\n\n| h |  | 2 |\n| --- | --- | --- |"
    assert loaders.front_matter("---\nname: a\nslash: /b\n---\nbody") == {"name": "a", "slash": "/b"}


@given(st.lists(st.text(alphabet="abc \n", max_size=10), max_size=5))
def test_sse_events(parts):
    stream = "".join(f"data: {p.replace(chr(10), ' ')}\n\n" for p in parts).encode()
    assert loaders.sse_events(stream) == [p.replace("\n", " ") for p in parts]


def test_files_from_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# A")
    (tmp_path / "sub" / "b.csv").write_text("x,y")
    (tmp_path / "sub" / "bad.docx").write_bytes(b"no zip")
    (tmp_path / ".hidden.md").write_text("h")
    files = loaders.scan_folder(spark, str(tmp_path), ("md", "csv", "docx"))
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error is None) for r in loaders.load_files(files).collect()}
    assert got == {"a.md": ("A", True), "b.csv": ("| x | y |\n| --- | --- |", True), "bad.docx": (None, False)}


def test_embedder_is_stable():
    a, b = hashing_embedder(["same words here", "same words here"])
    assert (a == b).all() and abs(float((a * a).sum()) - 1) < 1e-5


def test_compression():
    from sparkloom.operators import compress as C

    assert C.compress("one. two.", "q", 1.0) == "one. two."
    short = C.compress("The cat sat on the mat. NASA launched Apollo in 1969. It was a day.", "apollo", 3.0)
    assert "Apollo" in short and "The" not in short.split()
    assert C.compress("```\nx = 1 // note\n```", "q", 2.0) == "```\nx = 1\n```"
    assert C.keep_count(10, 4) == 5 and C.cut_bytes("aé", 2) == "a"
    assert "left out" in C.bounded_output("\n".join("x" * 600)) and C.bounded_output("a") == "a"


def test_near_vectors(spark):
    import numpy as np

    from sparkloom.operators.dedup import near_vector_pairs

    rng = np.random.default_rng(0)
    base = rng.standard_normal((40, 32))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([base, base + 0.1 * rng.standard_normal(base.shape)]))] + [(900, [float(x) for x in base[0]]), (901, None), (None, [1.0])]
    got = {(r.a, r.b) for r in near_vector_pairs(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v").collect()}
    assert {(i, i + 40) for i in range(40)} <= got | {(0, 40)} and len(got) >= 40


def test_contradictions_of_equal_vectors(spark):
    from sparkloom.operators.dedup import contradiction_candidates

    one, near, far = [1.0, 0.0, 0.0], [1.0, 0.05, 0.0], [0.0, 0.0, 1.0]
    # 1 and 2 are equal in two documents; the smallest holders of one and near lie in document 10
    rows = [(1, 10, one), (2, 20, one), (3, 10, near), (4, 30, near), (5, 30, far), (6, 40, [0.0] * 3), (7, 50, [0.0] * 3)]
    chunks = spark.createDataFrame([(c, d, c) for c, d, _ in rows], "chunk_id long, doc_id long, sequence long")
    vectors = spark.createDataFrame([(c, v) for c, _, v in rows], "chunk_id long, vector array<double>")
    got = sorted((r.a, r.b, r.doc_a, r.doc_b) for r in contradiction_candidates(chunks, vectors).collect())
    assert got == [(1, 2, 10, 20), (1, 4, 10, 30), (2, 3, 20, 10), (2, 4, 20, 30), (3, 4, 10, 30)]


def test_near_vectors_are_all_found_with_members(spark):
    import numpy as np

    from sparkloom.operators.dedup import near_vector_members, near_vector_pairs

    # 6,000 pairs at a cosine of about 0.92, in one plane each: bands of signs miss some of them
    rng = np.random.default_rng(1)
    base, turn = rng.standard_normal((2, 6000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    turn -= (turn * base).sum(axis=1, keepdims=True) * base
    turn /= np.linalg.norm(turn, axis=1, keepdims=True)
    other = 0.9201 * base + np.sqrt(1 - 0.9201**2) * turn
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, other]))] + [(20000, base[0].tolist()), (20001, base[0].tolist()), (20002, [1.0, 0.0]), (20003, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {(r.a, r.b) for r in near_vector_pairs(df, "id", "v").collect()}
    assert got == {(i, i + 6000) for i in range(6000)}
    reps = {r.id: r.rep for r in near_vector_members(df, "id", "v").collect()}
    assert len(reps) == 12003 and (reps[20000], reps[20001], reps[20002]) == (0, 0, 20002) and all(reps[i] == i for i in range(12000))


def test_graph_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(67)], "src long, dst long").coalesce(1)
    reached = graph.hops_from(chain, spark.createDataFrame([(0,)], "origin long"))
    assert sorted((r.node, r.hops) for r in reached.collect()) == [(i, i) for i in range(68)]
    with pytest.raises(RuntimeError):
        graph.components(chain, 1)
    assert {r.component for r in graph.components(chain).collect()} == {0}


def test_fold_paths_over_a_long_chain(spark):
    rows = [(i, i - 1 if i else None, 1, str(i % 10)) for i in range(300)] + [(900, 901, 1, "x"), (901, 900, 1, "y"), (950, 999, 1, "z")]
    nodes = spark.createDataFrame(rows, "id long, parent long, n long, s string")
    got = paths.fold_paths(nodes, ["n", "s"], lambda up, down: {"n": up["n"] + down["n"], "s": F.right(F.concat(up["s"], down["s"]), F.lit(3))})
    got = {r.id: r for r in got.collect()}
    assert [(got[i].root, got[i].n, got[i].state) for i in range(300)] == [(0, i + 1, "ok") for i in range(300)]
    assert got[299].s == "789" and got[1].s == "01"
    assert got[900].state == got[901].state == "cycle" and (got[950].state, got[950].root) == ("orphan", 999)


def test_semantic_lookup_takes_the_best_that_lives(spark):
    cache = spark.createDataFrame([(1, [1.0, 0.0], 100), (2, [1.0, 0.1], 900), (3, [1.0, 0.5], 950), (4, None, 950), (2, [1.0, 0.1], 900)], "cache_id long, query_embedding array<float>, created_at long")
    asked = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, -1.0])], "query_id long, query_vec array<float>")
    got = [(r.query_id, r.id) for r in caches.semantic_lookup(cache, asked, 0.5, 1000, 500).collect()]
    assert got == [(7, 2)]
    assert [(r.query_id, r.id) for r in caches.semantic_lookup(cache, asked, 0.5, 1000, 900).collect()] == [(7, 1)]
    assert caches.semantic_lookup(cache.limit(0), asked, 0.5, 1000, 500).count() == 0


def test_invalidation_by_name_in_quotes(spark):
    cache = spark.createDataFrame([(1, '[{"doc": "a.md"}]'), (2, '[{"doc": "aa.md"}]'), (3, None)], "id long, sources_json string")
    names = spark.createDataFrame([("a.md",), (None,)], "name string")
    assert {r.id for r in caches.invalidate_by_document(cache, names).collect()} == {2, 3}


def test_memories(spark):
    m = spark.createDataFrame([(1, "Rust", 0.5, 10, 0), (2, "rusty", 0.5, 20, 0), (3, "x", 1.0, 1, 0)], "memory_id long, content string, importance double, last_accessed long, access_count int")
    assert [r.memory_id for r in memory.search_memories(m, "RUST", 2).collect()] == [2, 1]
    read = memory.bump_access(m, m.where("memory_id = 2"), 99)
    assert {r.memory_id: (r.access_count, r.last_accessed) for r in read.collect()}[2] == (1, 99)
    pinned = {r.memory_id: (r.tier, r.importance) for r in memory.pin(m.withColumn("tier", F.lit("wing")), [1]).collect()}
    assert pinned[1] == ("room", 1.0) and pinned[2] == ("wing", 0.5)


def test_symbols_of_fenced_code(spark):
    text = "intro\n```rust\npub fn load_all() {}\nstruct Big;\n```\n~~~py\nclass A:\n    def f(self):\n        pass\n~~~\n```\nfn hidden() {}\n```"
    df = spark.createDataFrame([(1, text), (2, None), (3, "fn none() {}")], "k long, t string")
    got = [(r.id, r.name, r.kind) for r in symbols.symbols_of_texts(df, "k", "t").collect()]
    assert got == [(1, "load_all", "function"), (1, "Big", "struct"), (1, "A", "class"), (1, "f", "method")]
    words = one(spark, symbols.identifier_names(F.lit("how does HashMap::insert_all and fooBar work, x _")))
    assert words == ["HashMap", "insert_all", "fooBar"]


def test_backlinks_hold_names_in_targets(spark):
    made = spark.createDataFrame([(1, "My Notes (2)"), (2, "notes"), (3, None), (4, "")], "source long, target string")
    names = spark.createDataFrame([("Notes",), ("",), (None,), ("zz",)], "name string")
    assert {(r.name, r.source) for r in links.backlinks(made, names).collect()} == {("Notes", 1), ("Notes", 2)}
    assert links.backlinks(made, names.limit(0)).count() == 0


def test_summary_expansion_opens_every_level(spark):
    tree = spark.createDataFrame([("t", ["m1", "m2"]), ("m1", ["c1", "c2"]), ("m2", ["c3", "t"]), ("other", ["c9"])], "node string, child_ids array<string>")
    hits = spark.createDataFrame([("t",), ("m1",)], "node string")
    got = {(r.hit, r.chunk) for r in history.expand_summaries(tree, hits).collect()}
    assert got == {("t", "c1"), ("t", "c2"), ("t", "c3"), ("m1", "c1"), ("m1", "c2")}


def test_compaction_keeps_the_newest(spark):
    rows = [(1, i, "user", "x" * 40) for i in range(10)] + [(2, 1, "user", "y" * 4000), (2, 2, "assistant", "z")]
    m = spark.createDataFrame(rows, "c long, i long, role string, content string")
    out = history.compact_history(m, "c", ["i"], T.token_estimate("content"), 60).collect()
    assert sorted(r.i for r in out if r.c == 1 and r.part == 1) == [6, 7, 8, 9]
    assert [r.role for r in out if r.part == 0] == ["system"] and sum(r.c == 2 for r in out) == 2


def test_postings_follow_their_texts(spark):
    texts = spark.createDataFrame([(1, "Banana"), (2, "ab"), (3, None), (4, "bandana")], "id long, text string")
    index = retrieval.postings(texts)
    assert {(r.gram, r.id): r.tf for r in index.collect()}[("ana", 1)] == 2
    changed = spark.createDataFrame([(1, "cabana")], "id long, text string")
    gone = spark.createDataFrame([(4,)], "id long")
    index = retrieval.refresh_postings(index, changed, gone)
    found = retrieval.texts_with(index, spark.createDataFrame([("BANA",), ("ban",), ("an",)], "term string"))
    assert {(r.term, r.id) for r in found.collect()} == {("BANA", 1), ("ban", 1)}


def test_index_pipeline(spark):
    docs = spark.createDataFrame([(1, "# Head\nHashMap depends on Rust. See [[Other|x]].", 5), (2, "  ", 5), (3, None, 5), (1, "# Head\nHashMap depends on Rust. See [[Other|x]].", 6)], "doc_id long, text string, content int")
    out = index_documents(docs)
    assert {r.doc_id: (r.status, r.status_reason) for r in out["status"].collect()} == {1: ("indexed", None), 2: ("failed", "no text"), 3: ("failed", "no text")}
    assert [(r.doc_id, r.target) for r in out["links"].collect()] == [(1, "Other")]
    assert ("HashMap", "depends_on", "Rust") in {(r.src, r.relation_type, r.dst) for r in out["relations"].collect()}
    assert {r.entity for r in out["entities"].collect()} >= {"HashMap", "Rust"}
    assert out["propositions"].count() and out["chunks"].count() == 1
    again = index_documents(docs, done=docs.select("doc_id", F.md5("text").alias("file_hash")))
    assert {r.doc_id: r.status for r in again["status"].collect()}[1] == "unchanged"
    assert {n: t.count() for n, t in index_documents(docs.limit(0)).items()} == dict.fromkeys(out, 0)


def test_small_words_in_two_languages():
    assert compress.without_fillers("The cat, and THEIR (own) dogs -- 我们的书。 的") == "cat, dogs -- 们书。"


def test_agent_fields(spark):
    text = "Thought: x\nAction: search\nAction Input: cats\nobservation\nAction 2: read\nFinal Answer: done\nwell"
    assert [(a.number, a.tool, a.input) for a in one(spark, T.react_actions(F.lit(text)))] == [(None, "search", "cats"), (2, "read", "")]
    assert one(spark, T.final_answer(F.lit(text))) == "done\nwell" and one(spark, T.final_answer(F.lit("none"))) is None
    assert [one(spark, T.template_name_is_valid(F.lit(x))) for x in ("ok_1", "", "A", "x" * 33, "a\n")] == [True, False, False, False, False]


def test_running_sums_of_a_group_over_several_ranges(spark):
    rows = [("hot", i, i % 7) for i in range(500)] + [("b", 1, None), ("b", 2, 5), (None, 1, 4)]
    df = spark.createDataFrame(rows, "g string, i long, x long").repartition(3)
    got = {(r.g, r.i): (r.nth, r.s) for r in ranges.running(df, "g", [F.col("i")], {"s": F.col("x")}).collect()}
    total = 0
    for i in range(500):
        total += i % 7
        assert got["hot", i] == (i + 1, total)
    assert got["b", 1] == (1, 0) and got["b", 2] == (2, 5) and got[None, 1] == (1, 4)
    assert graph.shortest_path(spark.createDataFrame([("A", "B")], "src string, dst string"), "Q", "Q") == []
