import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from assayer.operators import audit as au
from assayer.operators import render as rd
from assayer.operators import retrieval as rt
from assayer.operators import validate as va
from assayer.plans.tools import REGISTRY, Registry
from assayer.sources import html, pages, stores
from assayer.sources import identifiers as ids

PAGE = """<html><head><title>T - arXiv</title><meta name="citation_title" content="The Title"><meta name="citation_author" content="A. One"><meta name="citation_author" content="B. Two"><style>p{}</style></head>
<body><article><h1>Head <b>line</b></h1><div class="abstract"><p>An  abstract.</p></div><h2>Intro</h2><p>First.</p><div>Second<script>var x;</script></div><h3>Deep</h3><p>Third.</p>
<table><caption>Cap</caption><tr><th>a</th><th>b</th></tr><tr><td>1</td></tr></table><figure><img src="f.png"><figcaption>Fig cap</figcaption></figure><h2>References</h2><ol><li>Some long reference text</li><li>short</li></ol></article></body></html>"""
ARXIV = """<h1 class="ltx_title ltx_title_document">On X</h1><span class="ltx_personname">A One</span><div class="ltx_abstract"><h6>Abstract</h6><p>We do.</p></div>
<section class="ltx_section"><h2>1 Intro</h2><p>Text.</p><section class="ltx_subsection"><h3>1.1 More</h3><div>Sub.</div></section></section>
<figure class="ltx_table"><figcaption>Tab</figcaption><table class="ltx_tabular"><tr><td>x</td></tr></table></figure><figure class="ltx_figure"><img src="g.png"></figure><section class="ltx_bibliography"><ul><li class="ltx_bibitem">Reference number one</li></ul></section>"""
PMC = """<h1 class="content-title">P</h1><a class="contrib-author">C Three</a><section><h2>Abstract</h2><p>Ab.</p></section><section><h3>Methods</h3><p>M.</p><div><p>no</p></div></section>
<div class="table-wrap"><div class="caption">TC</div><table><tr><td>1</td></tr></table></div><div class="fig-panel"><div class="caption">FC</div><img src="h"></div><section><h2>References</h2><ul><li>Another reference text</li></ul></section>"""


def test_generic_page():
    d = html.parse(PAGE, "generic")
    assert (d["title"], d["authors"], d["abstract"]) == ("The Title", ["A. One", "B. Two"], "An abstract.")
    assert [(s["title"], s["level"], s["content"]) for s in d["sections"]] == [("Head line", 1, "An abstract."), ("Intro", 2, "First. Second"), ("Deep", 3, "Third."), ("References", 2, "")]
    assert d["tables"] == [{"markdown": "| a | b |\n| --- | --- |\n| 1 |  |", "caption": "Cap", "rows": 2, "cols": 2}] and d["figures"] == [{"caption": "Fig cap", "url": "f.png"}] and d["references"] == ["Some long reference text"]


def test_layouts():
    a = html.parse(ARXIV, "arxiv")
    assert (a["title"], a["authors"], a["abstract"], a["references"]) == ("On X", ["A One"], "We do.", ["Reference number one"])
    assert [(s["title"], s["level"], s["content"]) for s in a["sections"]] == [("1 Intro", 1, "Text."), ("1.1 More", 2, "Sub.")] and a["tables"][0]["caption"] == "Tab" and a["figures"] == [{"caption": None, "url": "g.png"}]
    p = html.parse(PMC, "pmc")
    assert (p["title"], p["authors"], p["abstract"], p["references"]) == ("P", ["C Three"], "Ab.", ["Another reference text"])
    assert [(s["title"], s["level"], s["content"]) for s in p["sections"]] == [("Methods", 2, "M."), ("References", 1, "")] and p["tables"][0]["caption"] == "TC" and p["figures"] == [{"caption": "FC", "url": "h"}]
    c = html.parse('<h2 id="title">ACL title</h2><div class="acl-abstract"><span>Abs</span></div>', "acl")
    assert (c["title"], c["abstract"], c["sections"]) == ("ACL title", "Abs", [])
    assert html.parse(None, None)["title"] == "" and html.parse("</p><b>x", "generic")["sections"] == []


def test_parsed_pages(spark):
    rows = spark.createDataFrame([(1, PAGE, "generic"), (2, None, "pmc")], "page_id long, html string, layout string")
    got = {r.page_id: r for r in html.parse_pages(rows).collect()}
    assert got[1].raw_text == "An abstract.\n\nHead line\n\nAn abstract.\n\nIntro\n\nFirst. Second\n\nDeep\n\nThird.\n\nReferences" and got[2].raw_text == "" and got[2].markdown == "# \n"
    assert got[1].markdown.startswith("# The Title\n\n**Authors:** A. One, B. Two\n\n## Abstract\n\nAn abstract.\n\n## Head line\n\nAn abstract.\n\n### Intro") and got[1].markdown.endswith("## References\n\n1. Some long reference text\n")


@pytest.mark.parametrize("url, pdf", [
    ("https://x.org/a.PDF", "https://x.org/a.PDF"), ("https://www.biorxiv.org/content/10.1101/1v1/", "https://www.biorxiv.org/content/10.1101/1v1.full.pdf"), ("https://www.frontiersin.org/articles/9/full", "https://www.frontiersin.org/articles/9/pdf"),
    ("https://ojs.aaai.org/index.php/AAAI/article/download/1/2", "https://ojs.aaai.org/index.php/AAAI/article/download/1/2"), ("https://openreview.net/forum?id=abc&x=1", "https://openreview.net/pdf?id=abc"),
    ("https://proceedings.mlr.press/v9/p1.html", "https://proceedings.mlr.press/v9/p1/p1.pdf"), ("http://www.jmlr.org/papers/v7/hinton06a.html", "https://www.jmlr.org/papers/volume7/hinton06a/hinton06a.pdf"),
    ("https://journals.plos.org/plosone/article?id=10.1371/j.1", "https://journals.plos.org/plosone/article/file?id=10.1371/j.1&type=printable"), ("https://x.org/a", None),
])
def test_pdf_urls(spark, url, pdf):
    assert spark.range(1).select(ids.pdf_url(F.lit(url)).alias("p")).first().p == pdf


def test_page_texts(spark):
    t = "7\n1\n0\n2\n \ng\nu\nA\n" and "\n".join("7102gu") + "\nProximalPolicyOptimizationAlgorithmsForRobots28xAndMore\n\n\n\n a   b\tc"
    assert spark.range(1).select(pages.clean(F.lit(t)).alias("t")).first().t == "Proximal Policy Optimization Algorithms For Robots 28 x And More\n\na b c"
    blocks = spark.createDataFrame([("s", 1, 5.0, 9.0, "later"), ("s", 1, 5.0, 1.0, "be-\n gin"), ("s", 1, 0.0, 0.0, "  ")], "source_id string, page int, x0 double, y0 double, text string")
    assert [(r.block, r.text) for r in pages.ordered_blocks(blocks).orderBy("block").collect()] == [(0, "begin"), (1, "later")]
    chunks = pages.paged_chunks(spark.createDataFrame([("s", 2, "C."), ("s", 1, "A b. Cd e.")], "source_id string, page int, text string")).orderBy("chunk_index").collect()
    assert [(r.chunk_id, r.page, r.text, r.start_char) for r in chunks] == [("s_chunk_0", 1, "A b.", 0), ("s_chunk_1", 1, "Cd e.", 5), ("s_chunk_2", 2, "C.", 0)]


def test_stores(spark, tmp_path):
    papers = lambda *rows: spark.createDataFrame(list(rows), "paper_id string, title string")
    stores.save_table(spark, str(tmp_path), "papers", papers(("a", "1"), ("b", "1")))
    stores.save_table(spark, str(tmp_path), "papers", papers(("b", "2"), ("c", "2")))
    got = stores.load_table(spark, str(tmp_path), "papers")
    assert sorted(map(tuple, got.collect())) == [("a", "1"), ("b", "2"), ("c", "2")] and stores.load_table(spark, str(tmp_path), "claims") is None
    assert [r.title for r in stores.get(got, "paper_id", "b").collect()] == ["2"] and [r.paper_id for r in stores.listed(got, "paper_id").collect()] == ["a", "b", "c"]
    stores.write_json_lines(papers(("x", None), ("y", "q\n")), f"{tmp_path}/lines")
    assert sorted(map(tuple, stores.read_json_lines(spark, f"{tmp_path}/lines", "paper_id string, title string").collect())) == [("x", None), ("y", "q\n")]
    back = stores.from_documents(stores.to_documents(papers(("x", None)), "paper_id"), papers(("x", None)).schema)
    assert [tuple(r) for r in back.collect()] == [("x", None)]
    trace = spark.createDataFrame([("s1", 1), ("s2", 1)], "session_id string, sequence int")
    stores.append_traces(trace, str(tmp_path))
    stores.append_traces(trace.where("session_id = 's1'").withColumn("sequence", F.lit(2)), str(tmp_path))
    assert [r.sequence for r in rd.session_trace(spark.read.parquet(f"{tmp_path}/traces"), "s1").collect()] == [1, 2]
    doc = html.parse_pages(spark.createDataFrame([("p1", PAGE, "generic")], "source_id string, html string, layout string"))
    stores.save_papers(doc, f"{tmp_path}/papers_out")
    assert spark.read.json(f"{tmp_path}/papers_out/metadata").first().title == "The Title"


def test_validators(spark):
    rows = [("hyp_1", "A statement that is long enough.", "because", ["assume it"], ["x1"], ["y1"], 3, 0, "high", "a novel approach to everything", ["holds for all"], [(1, "changed a lot", "a good reason")]), ("h2", "short", "", [], ["same"], ["SAME"], 1, 3, "high", "", [], [(2, "x", "y")])]
    schema = "hypothesis_id string, statement string, rationale string, assumptions array<string>, independent_variables array<string>, dependent_variables array<string>, supporting_count int, contradicting_count int, qualitative_confidence string, novelty_basis string, boundary_conditions array<string>, revision_history array<struct<iteration:int,changes:string,rationale:string>>"
    got: dict = {}
    for r in va.problem_rows(spark.createDataFrame(rows, schema), "hypothesis", "hypothesis_id").collect():
        got.setdefault(r.hypothesis_id, set()).add((r.field, r.rule))
    assert "hyp_1" not in got
    assert got["h2"] == {
        ("hypothesis_id", "id_prefix_convention"), ("rationale", "non_empty_string"), ("statement", "statement_length"), ("assumptions", "no_hypothesis_without_assumptions"), ("variables", "variable_independence"),
        ("qualitative_confidence", "confidence_evidence_alignment"), ("qualitative_confidence", "confidence_evidence_count"), ("qualitative_confidence", "contradictions_acknowledged"), ("novelty_basis", "novelty_justification"),
        ("novelty_basis", "novelty_clarity"), ("boundary_conditions", "boundary_conditions_recommended"), ("revision_history[0].iteration", "revision_history_sequential"), ("revision_history[0].changes", "revision_quality"),
        ("revision_history[0].rationale", "revision_quality"),
    }


BAD = {
    "evidence": ("evidence_id string, source_id string, model_version string, page int, type string, caption string, units string, bounding_box string, extracted_data string", ("e", "s", "v", 0, "table", None, None, None, '{"columns": ["a"], "rows": [[1]]}'), {"page_number_valid", "table_caption_recommended", "numeric_units_recommended"}),
    "paper": ("paper_id string, title string, pdf_path string, abstract string, doi string, arxiv_id string, chunk_ids array<string>", ("x", "t", "p", None, None, "", ["a", "a"]), {"id_prefix_convention", "paper_metadata_completeness", "unique_chunk_ids"}),
    "cluster_map": ("map_id string, provenance array<string>, clusters array<struct<cluster_id:string,representative_paper_ids:array<string>,centroid_embedding:array<double>>>", ("map_1", None, [("c", [], [0.5]), ("c", ["p"], [])]), {"unique_cluster_ids", "cluster_representative_required", "cluster_centroid_required", "cluster_map_provenance"}),
    "critique": ("critique_id string, hypothesis_id string, severity string, counter_evidence array<string>, weak_assumptions array<string>, suggested_revisions array<string>", ("crit_1", "h", "high", [], None, []), {"critique_substance", "critique_actionability"}),
    "proposal": ("proposal_id string, hypothesis_id string, references array<string>", ("proposal_1", "", ["a", "a"]), {"non_empty_string", "proposal_reference_uniqueness"}),
    "session": ("session_id string, user_input string, phase string, active_paper_ids array<string>, hypothesis_ids array<string>", ("s", "", "p", ["a", "a"], ["h"]), {"id_prefix_convention", "non_empty_string", "session_active_paper_uniqueness"}),
    "context": ("context_id string, dataset string, range_min double, range_max double, cross_validation_folds int, split_type string", ("ctx_1", "d", 1.0, 1.0, 5, "train/test"), {"metric_range_order", "protocol_consistency"}),
    "normalized_claim": ("claim_id string, subject string, predicate string, metric_canonical string, metric string, normalized_claim_id string, source_claim_ids array<string>", ("c", "s", "p", "F1", "f1", "n1", ["d"]), {"id_prefix_convention", "metric_alias_consistency", "source_claim_traceability"}),
    "extraction_result": ("result_id string, paper_id string, provenance_page int, page_number int, artifact_type string, caption string, normalized_data string", ("extract_1", "p", 1, 2, "table", "", "{}"), {"extraction_page_alignment", "artifact_caption_recommended", "normalized_data_recommended"}),
    "contradiction_report": ("report_id string, claim_cluster_id string, consensus_claims array<string>, contradiction_pairs array<string>, uncertainty_markers array<string>", ("report_1", "c", [], None, []), {"report_non_empty"}),
}


@pytest.mark.parametrize("kind", BAD)
def test_each_validator(spark, kind):
    schema, row, rules = BAD[kind]
    got = va.validated(spark.createDataFrame([row], schema), kind).first()
    assert {p.rule for p in got.problems} == rules and got.is_valid == all(p.severity != "error" for p in got.problems)


def test_provenance_and_repeats(spark):
    e = spark.createDataFrame([(1, [("a",), ("",)])], "k int, evidence array<struct<source_id:string>>")
    assert [p.field for p in e.select(va.provenance().alias("p")).first().p] == ["evidence[1].source_id"] and va.repeated_ids(e.union(e), "k").count() == 1


def test_audits(spark):
    texts = lambda *t: spark.createDataFrame([(x,) for x in t], "text string")
    assert au.fuzzy_scores(texts("BERT achieves  accuracy", "unrelated thing"), texts("bert achieves accuracy")).first().asDict() == {"precision": 0.5, "recall": 1.0, "f1": 0.666667}
    runs = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("b", 1, "7"), ("b", 2, "8")], "document_id string, run int, digest string")
    assert [tuple(r) for r in au.determinism(runs).collect()] == [("b", "7", "8", 2)] and au.determinism_rate(runs).first().rate == 0.5
    rows = spark.createDataFrame([("a1", "p", "c", "high", False), ("a2", "", None, "LOW ", True), ("a3", "p", "", "medium", True)], "assertion_id string, paper_id string, chunk_id string, confidence string, ungrounded boolean")
    assert [r.assertion_id for r in au.ungrounded(rows).collect()] == ["a3"] and au.assertion_audit(rows).first().asDict() == {"checked": 3, "violations": 1, "passed": False}
    assert au.shape(json.loads('{"b": 1, "a": [null, "x", {"k": true}]}')) == {"a": ["null", "str", {"k": "bool"}], "b": "int"}


def test_vectors(spark):
    text = "some text"
    raw = hashlib.sha256(text.encode()).digest()
    x = [round(raw[i % 32] / 127.5 - 1, 6) for i in range(384)]
    norm = math.sqrt(sum(v * v for v in x))
    got = rt.hash_embedding(spark.createDataFrame([(text,), (None,)], "text string")).collect()
    assert got[0].embedding == pytest.approx([round(v / norm, 6) for v in x], abs=1e-6) and len(got[1].embedding) == 384
    corpus = spark.createDataFrame([(1, text, "a"), (2, "other", "b")], "doc_id long, text string, source string")
    assert (top := rt.retrieve(corpus, text, 1).first()) and (top.doc_id, top.score, top.method) == (1, 1.0, "semantic")
    assert [r.doc_id for r in rt.retrieve(corpus, text, 5, sources=["b", "c"]).collect()] == [2] and rt.retrieve(corpus, "some", 5, False).first().method == "lexical"
    blobs = spark.createDataFrame([(10 * b + i, [float(b * 100 + i % 3), float(b)]) for b in range(3) for i in range(8)], "vec_id long, embedding array<double>")
    found = {r.vec_id: r.cluster for r in rt.cluster(blobs).collect()}
    assert len(set(found.values())) >= 2 and len(found) == 24 and {r.cluster for r in rt.cluster(blobs.limit(2)).collect()} == {None}
    named = rt.cluster_map(blobs.withColumn("label", F.floor(F.col("vec_id") / 10)), spark.createDataFrame([(i, "the shared word and Alpha alpha") for i in range(30)], "vec_id long, text string")).collect()
    assert {r["name"] for r in named} == {"Alpha Shared Word"} and all(len(r.centroid) == 2 and len(r.representatives) == 3 and len(r.boundary) == 2 and r.members == 8 for r in named)


def replay(script, rounds=5):
    done, last, calm = 0, None, 0
    for x in script[:rounds]:
        if x is None:
            return done, "initial_hypothesis_failed" if not done else "critique_generation_failed"
        if math.isnan(x):
            return done, "revision_failed"
        done += 1
        if x >= 0.8:
            return done, "confidence_threshold_met"
        calm = calm + 1 if last is not None and abs(x - last) < 0.01 else 0
        if calm == 2:
            return done, "converged"
        last = x
    return done, "max_iterations_reached" if script else "initial_hypothesis_failed"


def test_loops(spark):
    scripts = [[0.9], [0.1, 0.8], [0.5, 0.505, 0.506, 0.9], [0.1, None], [0.1, math.nan], [None], [], [0.1, 0.2, 0.3, 0.4, 0.5, 0.9], [0.5, 0.505, 0.6, 0.605, 0.606]]
    got = {r.loop_id: (r.iterations, r.stopped_reason) for r in rd.replay_loops(spark.createDataFrame([(str(i), s) for i, s in enumerate(scripts)], "loop_id string, confidences array<double>")).collect()}
    assert got == {str(i): replay(s) for i, s in enumerate(scripts)}


def test_rendering(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(rd.escape_latex(F.lit("a_b & 5% \\ ~^{}#$"))) == "a\\_b \\& 5\\% \\textbackslash{} \\textasciitilde{}\\textasciicircum{}\\{\\}\\#\\$"
    assert one(rd.markdown_to_latex(F.lit("**b** *i*\n- x\n- y\nz\n- w"))) == "\\textbf{b} \\textit{i}\n\\begin{itemize}\n\\item x\n\\item y\n\\end{itemize}\nz\n\\begin{itemize}\n\\item w\n\\end{itemize}"
    table = one(rd.latex_table(F.lit("C&D"), F.array(F.lit("h"), F.lit("k")), F.array(F.array(F.lit("1%"), F.lit("2")))))
    assert "\\begin{tabular}{ll}" in table and "1\\% & 2 \\\\" in table and "\\caption{C\\&D}" in table


def test_proposals(spark):
    h = spark.createDataFrame([("hyp_1", "It works", "why", ["a1"], ["r1"], ["w1"], ["do x", "do y"]), ("hyp_2", "Bare", None, None, None, None, None), ("hyp_3", "", None, None, None, None, None)], "hypothesis_id string, statement string, rationale string, assumptions array<string>, known_risks array<string>, weak_assumptions array<string>, suggested_revisions array<string>")
    c = spark.createDataFrame([("hyp_1", 2, "S2", "gets", "5%", "BLEU", "ctx_wmt"), ("hyp_1", 1, "S1", "gets", "", None, "ctx_unknown")], "hypothesis_id string, ord long, subject string, predicate string, object_raw string, metric string, context_id string")
    r = spark.createDataFrame([("hyp_1", 1, "p1", "T1", ["A", "B"], "10.1/x"), ("hyp_1", 2, "p1", "again", [], ""), ("hyp_1", 3, "", "loose", [], None)], "hypothesis_id string, ord long, paper_id string, title string, authors array<string>, doi string")
    got = {x.hypothesis_id: x for x in rd.proposals(h, c, r).collect()}
    assert set(got) == {"hyp_1", "hyp_2"} and got["hyp_1"].proposal_id == "proposal_" + hashlib.sha256(b"hyp_1:It works").hexdigest()[:12]
    s = {x.heading: x.content for x in got["hyp_1"].sections}
    assert s["Novelty Statement"] == "**Hypothesis:** It works\n\nwhy\n\n**Identified gaps addressed:**\n- w1"
    assert s["Motivation"] == "This proposal is motivated by the following empirical evidence:\n\n- S1 gets \n- S2 gets 5% (metric: BLEU) [context: ctx_wmt]\n\n**Key assumptions:**\n- a1"
    assert s["Methodology Outline"] == "**Proposed approach:**\n\n1. Validate the hypothesis: *It works*\n2. do x\n3. do y\n\n**Risk mitigation:**\n- r1\n\n**Evaluation metrics:** BLEU"
    assert s["References"] == "[1] A, B. *T1*. DOI: 10.1/x (p1)\n[2] Unknown. *loose*."
    assert list(got["hyp_2"].warnings) == ["no supporting claims", "no references"] and "## References\n\n*No references provided.*" in got["hyp_2"].markdown


def test_tools(spark):
    assert len(REGISTRY.names()) == 15
    REGISTRY.check_pipeline(["ingestion", "extraction"])
    for wrong in ([], ["belief", "belief"], ["nothing"]):
        with pytest.raises(ValueError):
            REGISTRY.check_pipeline(wrong)
    with pytest.raises(ValueError):
        Registry([REGISTRY.get("rag"), REGISTRY.get("rag")])
    texts = spark.createDataFrame([("s", "BERT achieves 92.5% accuracy on GLUE.", 1)], "source_id string, text string, extra int")
    chunks = REGISTRY.get("ingestion")(texts=texts)
    claims = REGISTRY.get("extraction")(chunks=chunks)
    normal = REGISTRY.get("normalization")(claims=claims)
    belief = REGISTRY.get("belief")(claims=normal).first()
    assert (belief.context_id, belief.metric, belief.value_mean) == ("ctx_glue", "ACCURACY", 0.925) and REGISTRY.get("contradiction")(claims=normal).count() == 0
    with pytest.raises(ValueError):
        REGISTRY.get("extraction")(chunks=texts)
    for name in REGISTRY.names():
        json.dumps(REGISTRY.get(name).manifest())
    stored = spark.createDataFrame([("a", "t", ["x"], "")], "paper_id string, title string, authors array<string>, abstract string")
    assert REGISTRY.get("metadata_store")(stored=stored, operation="save", fresh=stored.withColumn("title", F.lit("new"))).first().title == "new"
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert REGISTRY.get("vector_store")(stored=vectors, query=[0.0, 1.0], k=1).first().vec_id == 2 and REGISTRY.get("vector_store")(stored=vectors, operation="delete", fresh=vectors.where("vec_id = 1")).count() == 1
    loops = spark.createDataFrame([("l", [0.9])], "loop_id string, confidences array<double>")
    assert REGISTRY.get("agent_loop")(loops=loops).first().stopped_reason == "confidence_threshold_met"
    chunk = spark.createDataFrame([("p", "c", 1, "Table 1: X.")], "paper_id string, chunk_id string, page long, text string")
    assert REGISTRY.get("multimodal")(chunks=chunk).first().caption == "X."
    assert REGISTRY.get("embedding")(texts=spark.createDataFrame([(1, "x")], "doc_id long, text string")).first().embedding and REGISTRY.get("mapping")(vectors=vectors).count() == 2
