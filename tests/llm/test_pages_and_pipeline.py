from __future__ import annotations

import os

import pytest

import corpus_pipeline
from docloom.llm import wrapper_extract as w

PAGE = '<html><head><title>T</title></head><body><nav><ul>{nav}</ul></nav><div class="ad">Buy {ad}</div><div class="post"><h1>{title}</h1>{body}</div><div class="comments"><p>{comment}</p></div><form><input>Search</form><footer>&copy; {foot}</footer></body></html>'


def page(i: int, paragraphs: int) -> str:
    body = "".join(f"<p>Text {i}.{k} &amp; more\n <b>bold</b> words that are long enough." + ("</p>" if k % 2 else "") for k in range(paragraphs))
    return PAGE.format(nav="<li><a>x</a></li>" * (i + 2), ad=i, title=f"Title {i}", body=body, comment=f"I think {i}", foot=i)


def want(i: int, paragraphs: int) -> str:
    return "\n".join([f"Title {i}", *(f"Text {i}.{k} & more bold words that are long enough." for k in range(paragraphs))])


def test_extract(spark):
    rows = [(i, "http://h.example/a" if i % 2 else None, page(i, i + 1), 1) for i in range(6)] + [(7, "bad", None, 1), (8, "http://h.example/b", "", 1), (9, "http://h.example/c", "plain < text &lt;3", 1)]
    got = {r.page_id: r for r in w.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()}
    for i in range(6):
        assert got[i].text == want(i, i + 1) and got[i].n_chars == len(want(i, i + 1))
    assert got[7].text == "" and got[8].text == "" and got[9].text == "plain < text <3"
    assert w.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrapper_is_a_union_free_expression():
    made = w.aligned(w.folded(w.stream(page(1, 2))), w.folded(w.stream(page(2, 4))))
    said = w.expression(made)
    assert "( <li> <a> \"x\" </a> </li> )+" in said and "#PCDATA" in said and "|" not in said
    optional = w.aligned(w.folded(w.stream("<body><h1>A</h1><p>x</p></body>")), w.folded(w.stream("<body><h1>B</h1><i>new</i><p>x</p></body>")))
    assert "( <i> \"new\" </i> )?" in w.expression(optional)


def test_template_text_is_left_out(spark):
    """Texts that are the same on all pages of a host go, though no tag or class tells; the wrapper's article is what is read."""
    body = '<html><body class="x"><div><h2>Host name</h2></div><div class="text"><h1>Title {0}</h1><p>First {0} of some length.</p><p>Second {0}, <a>here</a> too.</p><p>We ask <a>here</a> for consent.</p><div>By the editor</div></div><div><i>Seen {0:.2}</i></div></body></html>'
    rows = [(i, "http://h.example/a", body.format(f"{i} " * 9 * (i + 1))) for i in range(4)] + [(9, "http://h.example/b", "")]
    alone = [(20 + i, f"http://alone{i}.example/", body.format("of one page")) for i in range(2)]
    copies = [(30 + i, "http://copies.example/", body.format("of copies")) for i in range(3)]
    pages = spark.createDataFrame(rows + alone + copies, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text.split("\n") for r in w.extract(pages).collect()}
    for i in range(4):
        said = " ".join([str(i)] * 9 * (i + 1))
        assert got[i] == [f"Title {said}", f"First {said} of some length.", f"Second {said} , here too."]
    for i in (20, 21, 30, 31, 32):
        assert {"By the editor", "We ask here for consent."} <= set(got[i])


@pytest.mark.parametrize("tag", ['<body class="has-comments post">', '<article class="post with-sidebar">', '<div class="single no-sidebar">', '<div class="layout fixed-header">', '<main class="widget">', '<div id="sidebar">'])
def test_class_words_of_a_layout_never_drop_the_article(tag):
    page = f'{tag}<h1>Title</h1><p>a</p><svg width="1"/><p>b</p><iframe src="x"/><p>c</p><svg><text>no</text></svg><nav>no</nav></{tag[1:].split()[0]}>'
    assert w.main_text(page, w.article(w.folded(w.stream(page)))).split("\n") == ["Title", "a", "b", "c"]


@pytest.fixture(scope="module")
def stages(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("the driver's tables are not here")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        made = corpus_pipeline_kept(stage(spark, docs, folder))
        out.append((docs, made))
        docs = made
    return out


def test_near_duplicates_keep_one_row_of_each_group(spark):
    """Also where the rows of a group share a doc_id or have none."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(90))
    rows = [(5, text(0)), (5, text(0)), (None, text(1)), (None, text(1)), (None, text(1) + " more"), (7, text(2)), (3, text(2)), (None, text(2)), (8, text(3)), (8, text(4)), (9, ""), (9, None)]
    docs = spark.createDataFrame([(k, t, "en", "web", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert tuple(got.columns) == corpus_pipeline.COLUMNS
    left = [(r.doc_id, (r.text or "").split(" ")[0]) for r in got.collect()]
    assert sorted(left, key=str) == sorted([(5, "w0x0"), (None, "w1x0"), (3, "w2x0"), (8, "w3x0"), (8, "w4x0"), (9, ""), (9, "")], key=str)


def corpus_pipeline_kept(df):
    from docloom.llm.common import kept

    return kept(df)


def test_pipeline(stages):
    names = [k for k, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for before, after in stages[:3]:
        assert tuple(after.columns) == corpus_pipeline.COLUMNS
        ids = {r.doc_id: r.text for r in before.collect()}
        assert all(ids[r.doc_id] == r.text for r in after.collect()) and 0 < after.count() <= before.count()
    cut = {r.doc_id: r for r in stages[3][1].collect()}
    assert all(r.n_chars == len(r.text) and "�" not in r.text for r in cut.values())
    packed = stages[4][1].toPandas()
    assert set(packed.doc_id) == set(cut) and packed.groupby("sequence_id").length.sum().max() <= 1024
