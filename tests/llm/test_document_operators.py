"""Rules, models and page extraction against plain counts, held-out rows and hand-made cases."""

import collections
import re
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from framewright.llm import cleaning, html, languages, quality, registered, toxicity

EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (None, "no id here."), (5, "twice."), (5, "twice."), (6, "a b c " * 30_000)]
COLUMNS = "doc_id long, text string, score double, lang string, n_words int, kept string, label int"


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, 0.1, "xx", 7, "k", 1) for i, t in EDGE], COLUMNS)


def by_id(frame, key="doc_id"):
    found = collections.defaultdict(list)
    for row in frame.collect():
        found[row[key]].append(row.asDict())
    return found


# Line-first rules

def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_a_plain_rule(spark, edge, testdata):
    docs = spark.read.parquet(f"{testdata}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for i, rows in by_id(cleaning.clean(docs)).items():
        row = rows[0]
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == plain_counts(texts[i])
    found = by_id(cleaning.clean(edge))
    assert [len(found[i]) for i in (1, 2, 3, 4, None, 5, 6)] == [1, 1, 1, 1, 1, 2, 1]
    assert all(found[i][0]["n_words"] == 0 and found[i][0]["base_failed"] and not found[i][0]["kept"] for i in (1, 2, 3))
    assert found[6][0]["n_repeat_words"] == found[6][0]["n_words"] == 90_000 and found[6][0]["base_failed"]


def test_lines_go_first_then_documents(spark):
    good = "\n".join(f"Tale{i} went{i} slowly{i} home{i} again{i}." for i in range(12))
    menu = "Home | News | Sport | Weather | Contact"
    rows = [(1, good), (2, good + "\n" + menu), (3, "\n".join(f"Home{i} | News{i} | Sport{i}" for i in range(40)) + "\n" + good), (4, "AN ENTIRE LINE OF CAPITALS GOES ON.\n" + good)]
    found = by_id(cleaning.clean(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [found[i][0]["kept"] for i in (1, 2, 3, 4)] == [True, True, False, True]
    assert found[2][0]["clean_text"] == good == found[4][0]["clean_text"]


@pytest.mark.parametrize("line, fault", [
    ("A plain sentence ends well.", ""), ("A heading without an end", "punctuation"), ("Home | News | About us.", "navigation"),
    ("Please accept cookies to go on reading this page.", "boilerplate"), ("BUY THIS THING TODAY NOW!", "capitals"), ("some*** words*** here***.", "symbols"),
])
def test_line_faults(line, fault):
    assert cleaning.line_fault(line, line.encode().split(), cleaning.Rules()) == fault


# Languages

def test_languages_are_told_on_rows_held_out(spark, edge, testdata):
    docs = spark.read.parquet(f"{testdata}/documents.parquet")
    profiles = languages.train(docs.where(~registered.held_out(5, 0)))
    told = languages.identify(docs, profiles).join(docs.select("doc_id", "lang"), "doc_id").where(registered.held_out(5, 0)).collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in told]) > 0.95
    found = by_id(languages.identify(edge, profiles))
    assert all((found[i][0]["lang_pred"], found[i][0]["score"]) == ("und", 0.0) for i in (1, 2, 3))
    assert found[5][0] == found[5][1] and found[6][0]["lang_pred"] in profiles
    assert {r["lang_pred"] for r in languages.identify(edge, {}).collect()} == {"und"}
    assert languages.identify(edge.where("false"), profiles).count() == 0 and languages.train(edge.where("false")) == {}


def test_grams_equal_a_plain_count():
    text = "Ça va? a1b, éé Ça"
    want = collections.Counter()
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        padded = f"\1{word}\1"
        for n in (1, 2, 3):
            want.update(p for p in (padded[i : i + n] for i in range(len(padded) - n + 1)) if p.strip("\1"))
    codes, counts = languages.grams(text)
    assert dict(zip(codes.tolist(), counts.tolist(), strict=True)) == {
        sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g)): k for g, k in want.items()
    }


def test_out_of_place_distance():
    table = languages.Profiles({"a": [10, 11, 12], "b": [12, 13]}, size=5)
    assert table.distances(np.array([12, 10], np.uint64)).tolist() == [2 + 1, 0 + 5]


# Models

def accuracy(frame, labels, column):
    rows = frame.where("held_out").join(labels.select("doc_id", F.col(column).alias("label")), "doc_id").collect()
    return rows, np.mean([r["predicted"] == r["label"] for r in rows])


def test_toxicity_on_rows_held_out(spark, testdata):
    folder = testdata.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows, share = accuracy(registered.QUERIES["op7_noisy_or_toxicity"](spark, folder), labels, "toxic")
    assert share > 0.9 and all(0 <= r["score"] <= 1 for r in rows)


def test_toxic_sentences_are_found_from_document_labels(spark):
    draw = np.random.default_rng(2)
    calm = [f"calm{i}" for i in range(400)]
    docs = []
    for i in range(600):
        lines = [" ".join(draw.choice(calm, 8)) + "." for _ in range(6)]
        if i % 3 == 0:
            lines[2] = f"you vilest{'abc'[i % 2]} {draw.choice(calm)} nasty{i % 4}."
        docs.append((i, " ".join(lines), int(i % 3 == 0)))
    frame = spark.createDataFrame(docs, "doc_id long, text string, label int")
    model = toxicity.train(frame, frame)
    told = {r["doc_id"]: r["score"] for r in toxicity.score(frame, model).collect()}
    assert np.mean([(told[i] >= 0.5) == bool(y) for i, _, y in docs]) > 0.98
    bad = toxicity.sentences(frame, model).collect()
    assert len(bad) > 150 and all("nasty" in r["sentence"] for r in bad)


def test_length_alone_makes_no_text_toxic(spark, testdata):
    folder = testdata.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    labels = labels.select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.train(docs, labels.where(~registered.held_out(5, 0)))
    known = docs.select("doc_id", "text").join(labels, "doc_id")
    scored = toxicity.score(known, model, keep=("doc_id", "text", "label")).orderBy("doc_id").collect()
    toxic = [r["text"] for r in scored if r["label"] == 1 and r["score"] >= 0.5]
    assert len(toxic) / sum(r["label"] for r in scored) > 0.8
    clean = "\n".join(r["text"] for r in scored if r["label"] == 0 and r["text"] and r["score"] < 0.5)
    clean = "\n".join([clean] * (200_000 // len(clean.split()) + 1))
    rows = [(0, clean), (1, clean + "\n" + min(toxic, key=len)), (2, "word. " * 200_000)]
    told = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert told[0] < 0.5 <= told[1] and told[2] < 0.01


def test_toxicity_edges(spark, edge):
    model = toxicity.train(edge, edge)  # one class only
    found = by_id(toxicity.score(edge, model))
    assert found[1][0]["score"] == found[2][0]["score"] == found[3][0]["score"] == 0 and found[5][0] == found[5][1]
    none = toxicity.train(edge.where("false"), edge.where("false"))
    assert all(r["score"] < 0.01 for r in toxicity.score(edge, none).collect())
    kept = toxicity.score(edge, none, keep=tuple(edge.columns), name="_toxic")
    assert kept.columns == [*edge.columns, "_toxic"] and kept.count() == len(EDGE)


def test_quality_on_rows_held_out(spark, testdata):
    folder = testdata.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    frame = registered.QUERIES["op8_sparse_rule_quality"](spark, folder)
    rows, share = accuracy(frame, labels, "quality")
    assert share > 0.95 and all(0 <= r["score"] <= 1 for r in rows)
    assert "Python" not in frame._jdf.queryExecution().executedPlan().toString()  # rules are Spark expressions


def test_rules_as_column_equal_rules_by_hand(spark):
    draw = np.random.default_rng(4)
    x = draw.random((500, len(quality.STATISTICS)))
    y = ((x[:, 3] > 0.6) & (x[:, 5] <= 0.7)).astype(float)
    model = quality.fit(x, y)
    assert model.rules and len(model.rules) < 60
    odds = model.bias + sum(w * quality._holds(rule, x) for rule, w in model.rules)
    assert np.mean((odds > 0) == (y == 1)) > 0.97
    frame = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], ["doc_id", *quality.COLUMNS])
    told = {r["doc_id"]: r["score"] for r in quality.score(frame, model).collect()}
    assert all(abs(told[i] - 1 / (1 + np.exp(-odds[i]))) < 1e-9 for i in range(500))


def test_quality_edges(spark, edge):
    measured = quality.statistics(edge, keep=tuple(edge.columns))
    assert measured.count() == len(EDGE) and measured.columns[: len(edge.columns)] == edge.columns
    one_class = quality.train(measured, edge)
    assert not one_class.rules and {round(r["_s"], 6) for r in quality.score(measured, one_class, name="_s").collect()} == {1.0}
    assert quality.statistics(edge.where("false")).count() == 0
    assert quality.fit(np.zeros((0, len(quality.STATISTICS))), np.zeros(0)).rules == ()


# Pages

ARTICLE = "<h1>Title</h1><p>First one, with <a href=x>a link</a> &amp; more, all in one.</p><p>Second&nbsp;one\n here.</p>"


@pytest.mark.parametrize("page, text", [
    ("", ""), ("just text", "just text"), ("<p>open <b>x", "open x"), ("<p>a</p><p", "a"), ("<div>one<br>two</div>", "one two"),
    ("<script>var t='<p>no</p>'</script><style>p{}</style><!-- <p>no</p> --><p>yes</p>", "yes"),
    ("<nav><a href=a>Menu</a></nav>", ""), ("<p>5 &lt; 6 &#233; &eacute; &quot;q&quot;</p>", '5 < 6 é é "q"'),
    (f"<html><head><title>T</title></head><body><header>Site</header><nav><ul><li><a href=/>Home</a></ul></nav><article>{ARTICLE}</article>"
     "<aside><p>Side, note, with, commas, and more, and more text in it.</p></aside><div class='ad-box'><p>Buy, now, please.</p></div>"
     "<div id=comments><p>Great, post, thanks, for, this.</p></div><form><p>Name</p></form><footer>&copy; me</footer></body>",
     "Title First one, with a link & more, all in one. Second one here."),
    (f"<body><div class='cookie-notice'>We use cookies, ok?</div><div class='page has-sidebar'><div class='entry-content'>{ARTICLE}</div>"
     "<div class=sidebar><p>Other, things, to, read.</p></div></div></body>",
     "Title First one, with a link & more, all in one. Second one here."),
])
def test_articles(page, text):
    assert html.article(page) == text


LONG = "".join(f"<p>Paragraph {i} goes on, with commas, for a good while and says something that readers came for.</p>" for i in range(6))
LONG_TEXT = re.sub("<.*?>", " ", LONG).split()


@pytest.mark.parametrize("wrapper", [
    'class="elementor-widget elementor-widget-theme-post-content"', 'class="post social"', 'class="article-content related"', 'id="main-content-widget"',
    'class="social"', 'class="promo"', 'class="content nav-open"', 'class="sidebar"', 'class="page comments-open"',
])
@pytest.mark.parametrize("inner", ["{}", '<div class="elementor-widget-container">{}</div>', "<article>{}</article>"])
def test_furniture_words_on_containers_do_not_lose_the_article(wrapper, inner):
    aside = '<div class="share">Share this</div><div class="widget"><a href=/>Latest news</a></div><div class="comments"><p>Nice, thanks.</p></div>'
    for rest in ("", "<div>Site name</div>", aside):
        page = f"<body><nav><a href=/>Home</a></nav>{rest}<div {wrapper}>{inner.format(LONG)}</div><footer>About</footer></body>"
        assert html.article(page).split() == LONG_TEXT


def test_furniture_by_name_still_goes():
    near = '<div class="post-share">Share this post</div><div class="related"><p>More to read.</p></div><p class="promo">Buy now.</p><div class="ad">Ad text.</div>'
    replies = '<div class="comments">' + '<div class="comment-body"><p>I think, on the whole, that this is true and well said.</p></div>' * 9 + "</div>"
    for page in (f'<div class="content">{LONG}{near}</div>{replies}', f"<article>{near}{LONG}</article>{near}{replies}"):
        assert html.article(page).split() == LONG_TEXT
    assert html.article('<div class="ad">Buy this.</div>') == ""


def test_a_form_around_the_page_is_no_form():
    search = "<form action=/s><input name=q><p>Search this site</p></form>"
    inner = f'<div id=ctl00><div class="nav"><a href=/>Home</a></div>{LONG}</div><input type=hidden name=state value="x>y">'
    assert html.article(f"<body><form id=aspnetForm method=post>{inner}</form><footer>About</footer></body>").split() == LONG_TEXT
    assert html.article(f"<body><form><article>{LONG}</article></form>{search}</body>").split() == LONG_TEXT
    terms = "<form>" + "<p>By sending this you agree, fully, to all terms, now and later, as they stand.</p>" * 12 + "</form>"
    assert html.article(f"<body><article>{LONG}</article>{terms}{search}</body>").split() == LONG_TEXT
    assert html.article(f"<body><div>{LONG}{search}</div></body>").split() == LONG_TEXT


@pytest.mark.parametrize("tag", ["<a href=x title=Bob's>", "<a href=x title=5\">", "<b data-x = 'a > b' class=\"c > d\">", "<i title=a'b'c>", "<img alt=don't>"])
def test_quotes_in_attributes(tag):
    name = re.match("<([a-z]+)", tag).group(1)
    page = f"<article><p>First {tag}one</{name}> here, it's so.</p><p>Second, Ann's turn.</p></article>"
    assert html.article(page) == "First one here, it's so. Second, Ann's turn."


def test_a_title_before_the_container():
    page = f'<body><div class="top"><h1>The title</h1></div><div><div class="wrap"><div>{LONG}</div></div></div></body>'
    assert html.article(page).split() == ["The", "title", *LONG_TEXT]
    logo = f"<body><h1><a href=/>Site name</a></h1><div><div><div>{LONG}</div></div></div></body>"
    assert html.article(logo).split() == LONG_TEXT
    own = f"<body><div><h1>Site</h1></div><div><article><h1>Own</h1>{LONG}</article></div></body>"
    assert html.article(own).split() == ["Own", *LONG_TEXT]


@pytest.mark.parametrize("piece", ["<i>word {}, <p>", "<i>word {} ", "<i><li></li>word {}", "<i></b>word {}<br>", "<a>word {}<div>", "<i><header>x</header>word {}<br>", "<p title='{}>word ", "<div class=ad><i>word {}"])
def test_unclosed_elements_take_time_in_proportion(piece):
    start = time.perf_counter()
    html.article("".join(piece.format(i) for i in range(100_000)))
    assert time.perf_counter() - start < 10  # some 2 seconds


def test_deep_and_long_pages_are_read_whole():
    words = " ".join(f"w{i}" for i in range(50_000))
    assert html.article(f"<article><p>{words}</p></article>") == words
    assert html.article("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_pages_of_the_tables(spark, testdata):
    rows = registered.QUERIES["op6_tree_scored_html"](spark, testdata).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{testdata}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for row in rows:
        inside = re.search(r"<article>(.*?)(</article>|\Z)", pages[row["page_id"]], re.S).group(1)
        plain = " ".join(__import__("html").unescape(re.sub(r"</?b>", "", re.sub(r"<(/?p|br|/?h1)>", " ", inside))).split())
        assert (row["text"], row["n_chars"]) == (plain, len(plain))


def test_page_edges(spark):
    rows = [(1, None, None, 1), (None, "u", "<p>x</p>", 2), (2, "u", "", 3), (2, "u", "", 3)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    assert sorted((r["page_id"] or 0, r["url"], r["text"], r["n_chars"]) for r in html.extract(frame).collect() if r["url"]) == [(0, "u", "x", 1), (2, "u", "", 0), (2, "u", "", 0)]
    assert html.extract(frame.where("false")).count() == 0


def test_toxicity_learns_from_so_many_bytes(spark):
    rows = [(i, i % 2, "x" * (10 * i)) for i in range(1, 60)] + [(99, 1, "y" * 10_000), (100, 0, None)]
    frame = spark.createDataFrame(rows, "doc_id long, label int, text string")
    every = toxicity._within(frame, 10**6)
    assert every.count() == len(rows)
    kept = toxicity._within(frame, 5_000).agg(F.sum(F.length("text")).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    assert 4_000 < kept["n"] <= 5_000 and kept["rows"] > 10
    calm = [(i, "a calm text about gardens. " * 5, 0) for i in range(40)] + [(100 + i, f"you are zorgle number {i}. a calm text.", 1) for i in range(40)]
    table = spark.createDataFrame(calm, "doc_id long, text string, label int")
    model = toxicity.train(table, table, sample_bytes=5_000)
    found = {r["doc_id"]: r["score"] for r in toxicity.score(table, model).collect()}
    assert all((found[i] >= 0.5) == bool(label) for i, _, label in calm)


# Against SQL

@pytest.mark.parametrize("name", list(registered.SQL))
def test_queries_equal_their_sql(spark, testdata, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "labels"):
        con.execute(f"create view {table} as select * from '{testdata}/{table}.parquet'")
    want = con.sql(entry.oracle_sql()[name]).df()
    found = entry.queries()[name](spark, testdata).toPandas()[list(want.columns)]

    def plain(table):  # missing values of every kind as None
        table = table.astype(object).where(table.notna(), None)
        return sorted(map(tuple, table.to_numpy().tolist()), key=lambda row: tuple((v is None, str(v)) for v in row))

    assert plain(found) == plain(want)


def test_samples_are_bounded_and_stable(spark):
    from framewright.llm.sampling import labelled_sample

    labels = spark.createDataFrame([(i % 900, i % 2) for i in range(2000)] + [(None, 1), (5000, None)], "doc_id long, label int")
    few = labelled_sample(labels, 100, F.max).collect()
    assert len(few) == 100 and sorted(few) == sorted(labelled_sample(labels.repartition(7), 100, F.max).collect())
    every = {r["doc_id"]: r["label"] for r in labelled_sample(labels, 5000, F.min).collect()}
    assert set(every) == set(range(900)) and every[1] == 1 and every[2] == 0
    assert labelled_sample(labels.where("false"), 10, F.max).count() == 0
