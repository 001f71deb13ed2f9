"""The training-data operators on small tables, against brute force and in odd cases."""

import math
import pickle
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import compare, connect
from runledger.llm import common
from runledger.llm import near_duplicates as nd
from runledger.llm import pitman_yor as py
from runledger.llm.components import connected_components
from runledger.llm.decontaminate import contamination, words
from runledger.llm.html_text import extract_text, main_text
from runledger.llm.line_dedup import dedup_lines
from runledger.llm.mixing import mix
from runledger.llm.pitman_yor import Seating, score_texts
from runledger.llm.quality import MEASURES, judge_quality
from runledger.llm.queries import oracle_sql, queries
from runledger.llm.token_counts import MARK, Counter as TokenCounter, Vocabulary, count_tokens
from runledger.llm.toxicity import FEATURES, _Weights, features, toxicity
from runledger.llm.url_filter import Cascade, judge_urls

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, uid long, score double, `kept` string, doc string, `a.b` int"
PAGE = "page_id long, url string, html string, host string, text string"


def odd_documents(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows and columns named like results."""
    line = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 6
    rows = [
        (1, line, "en", "a"), (1, line, "en", "a"), (2, line.strip() + " end", "en", "a"), (3, None, None, None),
        (None, line, "en", None), (None, None, None, None), (4, "", "de", "b"), (5, "one", "de", "b"),
        (6, "\n\n \t\n", "en", "a"), (7, "word " * 30_000, "en", "a"), (8, f"x\n{line}\n{line}\ny", "en", "b"),
        (9, "ünïcode 漢字 \U0001F600", "fr", "c"),
    ]
    return spark.createDataFrame([(*r, 7, 0.5, "k", "d", 3) for r in rows], SCHEMA)


def labels(spark):
    return spark.createDataFrame([(k, k % 2, k % 2) for k in range(1, 9)], "doc_id long, quality int, toxic int")


def items(spark):
    return spark.createDataFrame([(10, "Alpha, beta gamma"), (11, None), (12, ""), (None, "one")], "item_id long, text string")


OPERATORS = {
    "near": lambda s, d: nd.near_duplicates(d), "mix": lambda s, d: mix(d), "quality": lambda s, d: judge_quality(d),
    "lines": lambda s, d: dedup_lines(d), "leaks": lambda s, d: contamination(d, items(s)),
    "toxic": lambda s, d: toxicity(d, labels(s)), "model": lambda s, d: score_texts(d),
    "tokens": lambda s, d: count_tokens(d, Vocabulary((("a", -1.0), (MARK + "w", -2.0)), True)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    docs = odd_documents(spark)
    rows = OPERATORS[name](spark, docs).collect()
    assert len(rows) == docs.count()
    assert len({c.lower() for c in rows[0].asDict()}) == len(rows[0])
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in docs.collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, odd_documents(spark).limit(0)).count() == 0


def test_pages_odd_rows_and_empty(spark):
    rows = [(1, "http://A.Example.ORG/es/x?q", "<p>a&amp;b", "h", "t"), (2, None, None, None, None), (2, None, "", None, None), (3, "no scheme", "<nav>x</nav>", "h", "t")]
    pages = spark.createDataFrame(rows, PAGE)
    judged = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages).collect()}
    assert (1, "a.example.org", "/es/x", "example.org/es/", "block") in judged
    assert (3, "", "", None, "allow") in judged
    texts = {(r.page_id, r.text, r.n_chars) for r in extract_text(pages).collect()}
    assert texts == {(1, "a&b", 3), (2, "", 0), (3, "", 0)}
    assert judge_urls(pages.limit(0)).count() == extract_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_query_against_sql(spark, name):
    rows, problems = compare(spark, connect(SF), SF, queries()[name], oracle_sql()[name])
    assert not problems and rows > 0


def brute_components(texts, n, percent):
    sets = {}
    for i, text in texts.items():
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * len(sets[a] | sets[b]):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("crowd", [64, 3])
def test_near_duplicates_match_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(nd, "_CROWD", crowd)
    monkeypatch.setattr(nd, "_BLOCK_ROWS", 8)
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in rng.integers(0, 400, 90)]
    texts = {}
    for i in range(120):
        copy = list(base) if i % 3 else [f"v{k}" for k in rng.integers(0, 90, 40)]
        for place in rng.integers(0, len(copy), rng.integers(0, 10)):
            copy[place] = f"m{rng.integers(0, 50)}"
        texts[i] = " ".join(copy)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in nd.near_duplicates(rows, n=2).collect()}
    assert got == brute_components(texts, 2, 80)


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2))
    b = np.unique(np.r_[a[:3000], rng.integers(0, 1 << 63, 600, dtype=np.uint64) * np.uint64(2)])
    same = (nd.registers(a) == nd.registers(b)).mean()
    assert abs(same - 3000 / len(set(a) | set(b))) < 0.15
    assert nd.chance_collisions(4000) < 0.001


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 9), (9, 5), (7, 7), (None, 1)] + [(k, k + 1) for k in range(20, 60)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[k] for k in (1, 2, 3)} == {1} and got[9] == 5 and got[60] == 20 and 7 not in got


def test_runs_of_lines(spark):
    part = " ".join(f"p{k}" for k in range(30))
    rows = [(1, f"start\n{part}\n{part[::-1]}\nmid"), (2, f"{part}\n{part[::-1]}\nend"), (3, f"{part}\nother")]
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_words=50).collect()}
    assert got == {1: rows[0][1], 2: "end", 3: rows[2][1]}


def test_contamination_of_short_items(spark):
    docs = spark.createDataFrame([(1, "say alpha-BETA gamma one"), (2, "beta alpha"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in contamination(docs, items(spark)).collect()}
    assert got == {1: (5, 4, 1, True), 2: (2, 0, 0, False), 3: (0, 0, 0, False)}
    assert words("Ab-cd é9") == [b"ab", b"cd", "é9".encode()]


def test_cascade_is_exact(spark):
    keys = spark.range(3000).selectExpr("concat('k', id) AS key", "id % 7 = 0 AS listed")
    cascade = Cascade(keys)
    wrong = keys.withColumn("f", cascade.filters()).where(cascade.has(F.col("key"), F.col("f")) != F.col("listed"))
    assert wrong.count() == 0 and len(cascade.levels) > 1


def test_a_list_longer_than_a_plan_holds_is_exact(spark):
    """Some levels or all of them are tables; verdicts are those of levels that are values."""
    keys = spark.range(3000).selectExpr("concat('k', id) AS key", "id % 7 = 0 AS listed")
    for most in (0, 200):
        cascade = Cascade(keys, most)
        assert cascade.large and (most == 0) == (len(cascade.large) == len(cascade.levels))
        found = cascade.listed(keys.select("key"))
        assert sorted(r.key for r in found.collect()) == sorted(r.key for r in keys.where("listed").collect())
        with pytest.raises(ValueError):
            cascade.filters()
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").withColumn("host_on_list", F.lit(1))
    pages = pages.unionByName(spark.createDataFrame([(-1, None, 1), (-2, "no scheme", 1)], pages.schema))
    pages = pages.unionByName(pages.limit(5))
    expected = sorted(map(tuple, judge_urls(pages).collect()), key=str)
    assert sorted(map(tuple, judge_urls(pages, most_bytes=0).collect()), key=str) == expected
    assert {row[-1] for row in expected} == {"allow", "block"}


def test_tokens_match_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    pieces = [(MARK, -2.0), (MARK + "a", -3.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("bab", -2.5)]
    model = tokenizers.Tokenizer(tokenizers.models.Unigram([("<unk>", -3.0), *pieces], unk_id=0, byte_fallback=False))
    counter = TokenCounter(Vocabulary(tuple(pieces), False))
    rng = np.random.default_rng(3)
    for _ in range(300):
        text = "".join(rng.choice(list("abab é\n"), rng.integers(1, 14)))
        assert counter.count(text)[0] == len(model.encode(MARK + text.replace(" ", MARK)).ids), text


def test_memory_of_a_text_without_spaces_is_bounded():
    counter = TokenCounter(Vocabulary((("a", -1.0), ("ab", -1.5), ("b", -1.0), (MARK, -1.0)), True))
    tracemalloc.start()
    try:
        found = counter.count("ab" * 200_000)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == (200_001, -300_001.0, 0)
    assert peak < 8 << 20 and not counter.known


def test_quality_counts_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in queries()["op4_quality"](spark, SF).collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id])
        places = defaultdict(list)
        for k in range(len(w) - 7):
            places[tuple(w[k : k + 8])].append(k)
        repeated = {k + d for found in places.values() if len(found) > 1 for k in found for d in range(8)}
        lines = [x for x in texts[r.doc_id].split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(repeated))
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in texts[r.doc_id])
        assert r.base_failed == (len(w) < 20 or 100 * len(repeated) > 30 * len(w)) and not (r.base_failed and r.kept)


def quartile_fences(rows, lang, source, value, spread, low_too, ranges=5.0, prior=100):
    """Fences by brute force: every text's bucket with a weight, the group's own and those of its language and of all."""
    def middle(v):
        bits = max(0, len(bin(v)) - 2 - 6)
        return ((v >> bits) * 2**bits + (2**bits - 1) / 2) / 1e6, (v >> bits) << bits

    def weighted(chosen):
        found = Counter(middle(value(r)) for r in chosen)
        return {k: 10_000 * n for k, n in found.items()}

    def blended(own, base):
        total = sum(base.values())
        return Counter(own) + Counter({k: prior * 10_000 * n // total for k, n in base.items()})

    of_lang = blended(weighted([r for r in rows if r.lang == lang]), weighted(rows))
    of_group = blended(weighted([r for r in rows if r.lang == lang and r.source == source]), of_lang)
    total, upto, quarters = sum(of_group.values()), 0, {}
    for place, n in sorted(of_group.items(), key=lambda x: x[0][1]):
        upto += n
        for part in (1, 3):
            if part not in quarters and 4 * upto >= part * total:
                quarters[part] = place[0]
    width = ranges * max(quarters[3] - quarters[1], spread)
    return (quarters[1] - width if low_too else -1), quarters[3] + width


def test_quality_verdicts_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300")
    rows = judge_quality(docs).collect()
    fences = {}

    def scaled(part, whole):
        return lambda r: r[part] * 1_000_000 // r[whole] if r[whole] else 0

    for r in rows:
        inside = True
        for part, whole, low_too, spread in MEASURES.values():
            key = (r.lang, r.source, part, whole)
            if key not in fences:
                fences[key] = quartile_fences(rows, r.lang, r.source, scaled(part, whole), spread, low_too)
            low, high = fences[key]
            inside = inside and low <= scaled(part, whole)(r) / 1e6 <= high
        assert r.kept == (inside and not r.base_failed), r
    assert {r.kept for r in rows if not r.base_failed} == {True, False}


def test_one_more_text_changes_no_verdict_by_a_jump(spark):
    """A source of loud texts among quiet ones: its texts are judged alike with 199 and with 200 of them."""
    def kept(n):
        quiet = [(k, " ".join(f"w{k + j}" for j in range(40)), "en", "quiet") for k in range(2000)]
        loud = [(10_000 + k, " ".join(f"v{k + j}!" if j < 4 + k % 24 else f"v{k + j}" for j in range(40)), "en", "loud") for k in range(n)]
        docs = spark.createDataFrame(quiet + loud, "doc_id long, text string, lang string, source string")
        return {r.doc_id for r in judge_quality(docs).where("source = 'loud' AND kept").select("doc_id").collect()}

    assert len(kept(199) ^ kept(200)) <= 1


def test_main_text():
    page = (
        "<html><body><nav><a href=x>menu</a></nav><div class='cookie-notice'>We use cookies</div><article><header><h1>Title</h1>"
        "</header><p>First &amp; long paragraph with many words in it.<p>Short.<div class=ad>Buy</div><form>mail</form>"
        "<pre>a\n  b</pre></article><aside>side</aside><section id=comments><p>I disagree with this long comment very much.</section>"
        "<footer>&copy; x</footer></body></html>"
    )
    assert main_text(page) == "Title\nFirst & long paragraph with many words in it.\nShort.\na b"
    assert main_text(None) == main_text("") == ""


def test_main_text_of_pages_without_article_and_of_split_bodies():
    def paragraphs(word, n):
        return "".join(f"<p>{(word + ' ') * 80}{k}</p>" for k in range(n))

    links = "<div class=x><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></div>"
    # Two sections and a heading in one container; the first section has the larger sum.
    split = f"<div><h1>The heading</h1><section>{paragraphs('first', 10)}</section><h2>More</h2><section>{paragraphs('other', 8)}</section></div>"
    lines = main_text(f"<html><body>{links}{split}{links}</body></html>").split("\n")
    assert lines[0] == "The heading" and lines[11] == "More" and len(lines) == 20
    assert [x.split()[0] for x in lines[1:11] + lines[12:]] == ["first"] * 10 + ["other"] * 8
    # Containers far apart, with links between them.
    apart = f"<div>{paragraphs('first', 5)}</div>{links}<div><div>{paragraphs('other', 6)}</div></div>"
    assert [x.split()[0] for x in main_text(f"<body>{apart}</body>").split("\n")] == ["first"] * 5 + ["other"] * 6
    # The tag <main> does not make links text.
    wide = f"<main><article>{paragraphs('first', 5)}</article>{links}</main>"
    assert [x.split()[0] for x in main_text(f"<body>{wide}</body>").split("\n")] == ["first"] * 5
    # One paragraph whose only child is as long does not outweigh the short ones beside it.
    short = f"<p><b>{'first ' * 80}<br></b></p><p>Short.</p>"
    assert main_text(f"<body>{links}<div>{short}</div></body>").split("\n")[-1] == "Short."
    assert main_text(f"<body>{links}{short}{links}</body>").split("\n")[-1] == "Short."
    # Text without elements of its own, and a page of text only.
    assert main_text("<body>Some words <b>in bold</b> here</body>") == "Some words in bold here"


def test_names_of_layouts_drop_no_article_text():
    text = "".join(f"<p>{'word ' * 60}{k}</p>" for k in range(6))
    links = "<div class=x><a href=1>one</a> <a href=2>two</a></div>"
    words = [f"{'word ' * 60}{k}".strip() for k in range(6)]
    for name in ("content has-sidebar", "elementor-widget-text-editor", "hentry comments-open", "article-body no-ads"):
        assert main_text(f"<body>{links}<div class='{name}'>{text}</div>{links}</body>").split("\n") == words
    assert main_text(f"<body><article><h1>T</h1><div class='article-body no-ads'>{text}</div></article></body>").split("\n") == ["T", *words]
    noticed = f"<body><article>{text}<div class='section-with-notice'>{text}</div></article></body>"
    assert main_text(noticed).split("\n") == words * 2
    # Parts of a page builder hold the text together; what is named otherwise, or links, still goes.
    parts = "".join(f"<div class='elementor-widget-text-editor'>{text}</div>" for _ in range(3))
    built = f"<body>{parts}<div class='widget-text'><a href=1>{'link ' * 99}</a></div><div class='sidebar-text'>About us.</div></body>"
    assert main_text(built).split("\n") == words * 3
    # Beside an article the same names are furniture.
    beside = f"<body><article>{text}</article><div class='sidebar-content'>{text}</div><div class='widget widget_text'>{text}</div></body>"
    assert main_text(beside).split("\n") == words


def test_short_blocks_beside_kept_ones_stay():
    text = "".join(f"<p>{'word ' * 60}{k}</p>" for k in range(6))
    links = "<div><a href=1>one</a> <a href=2>two</a></div>"
    page = (
        f"<body>{links}<div><h1>Title</h1><p>By me</p><div>A standfirst</div><section>{text}</section><div>Between</div>{links}"
        f"<section>{text}</section><section><p>One sentence.</p></section><div>Not of the text</div></div>{links}</body>"
    )
    got = main_text(page).split("\n")
    assert got[:3] == ["Title", "By me", "A standfirst"] and got[9] == "Between" and got[-1] == "One sentence."
    assert len(got) == 17


def test_parts_of_known_characters_need_no_unknown_ones(monkeypatch):
    """The short way gives the pieces of the long one, also among equal scores, and is the one taken."""
    rng = random.Random(3)
    letters = MARK + "abc"
    words = {"".join(rng.choices(letters, k=rng.randint(2, 5))) for _ in range(60)}
    pieces = tuple((p, float(-rng.randint(1, 4) * len(p))) for p in [*letters, *sorted(words)])
    counter = TokenCounter(Vocabulary(pieces, True))
    parts = ["".join(rng.choices(letters, k=rng.randint(1, 40))) for _ in range(500)]
    long_way = [counter._solve(p) for p in parts]
    assert [counter._solve_known(p) for p in parts] == long_way
    monkeypatch.setattr(counter, "_solve", None)
    assert counter.count("ab c")[2] == 0
    with pytest.raises(TypeError):
        counter.count("x")


def test_seating_keeps_customers():
    customers = np.array([1, 2, 3, 50, 1000])
    seats = Seating(customers, np.full(5, 0.7), 0.6, np.random.default_rng(0))
    for _ in range(20):
        seats.sweep(10)
    sums = np.add.reduceat(seats.sizes, seats.first[:-1])
    assert (sums == seats.customers).all() and (seats.sizes >= 0).all()
    occupied = np.add.reduceat((seats.sizes > 0).astype(int), seats.first[:-1])
    assert (occupied[np.argsort(seats.order)] == seats.tables).all() and seats.tables[0] == 1


def test_ways_to_seat_many_customers_equal_the_listed_ones(monkeypatch):
    monkeypatch.setattr(py, "LISTED", 700)
    for discount in (0.05, 0.5, 0.75, 0.95):
        listed = py._ways.__wrapped__(discount)
        for n in (201, 700):
            tables = np.arange(1, n + 1)
            got = py._log_ways(np.full(n, n), tables, discount) + math.lgamma(n + 1)
            assert np.abs(got - listed[n, 1 : n + 1]).max() < 1e-6


def test_tables_are_neither_bounded_nor_left_at_a_guess():
    """Mean and spread of the tables drawn are those of the distribution, counted one customer at a time."""
    rng = np.random.default_rng(1)
    for n, weight, discount in ((150, 40.0, 0.5), (600, 0.5, 0.75), (600, 900.0, 0.3), (5000, 2000.0, 0.8), (3, 2.0, 0.4)):
        logs = np.full(n + 1, -np.inf)
        logs[1] = math.log(weight)
        tables = np.arange(1, n + 1)
        for k in range(1, n):
            stay = np.where(tables <= k, np.log(np.maximum(k - discount * tables, 1e-300)), 0.0) + logs[1:]
            logs[1:] = np.logaddexp(logs[:-1] + math.log(weight), stay)
        p = np.exp(logs[1:] - logs.max())
        p /= p.sum()
        mean, spread = (p * tables).sum(), math.sqrt((p * tables**2).sum() - (p * tables).sum() ** 2)
        seats = Seating(np.full(2000, n), np.full(2000, weight), discount, rng)
        seats.sweep()
        assert abs(seats.tables.mean() - mean) < 5 * spread / math.sqrt(2000) + 1e-9
        assert abs(seats.tables.std() - spread) < 0.1 * spread + 1e-9


def test_model_beats_base_on_held_out_texts(spark):
    rows = [r for r in queries()["op1_pitman_yor"](spark, SF).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_sums_of_contexts_are_exact(spark):
    # More contexts than 2^20, some of which any fixed array would fold together.
    rng = np.random.default_rng(2)
    contexts = np.unique(rng.integers(0, 1 << 63, 1_200_000, dtype=np.uint64))
    own, lists, sums = [], [], Counter()
    for part in range(3):
        mine = np.sort(rng.choice(contexts, len(contexts) // 2, replace=False))
        values = rng.integers(1, 9, len(mine))
        for shard in range(3):
            cut = mine % np.uint64(3) == shard
            own.append((part, shard, bytearray(py._pack(mine[cut], values[cut], 2 * values[cut]))))
        lists.append((part, mine))
        sums.update(dict(zip(mine.tolist(), values.tolist())))
    model = spark.createDataFrame([(part, bytearray(b"m")) for part, _ in lists], "part int, model binary")
    rows = py._context_sums(spark.createDataFrame(own, "part int, shard long, data binary"), model).collect()
    got = {r.part: py._unpack(bytes(r.sums)) for r in rows}
    for part, mine in lists:
        expected = np.array([sums[c] for c in mine.tolist()])
        assert (got[part][0] == expected).all() and (got[part][1] == 2 * expected).all()


def test_a_context_has_only_its_own_followers(spark):
    # Every context has one follower: with restaurants of its own, none is known in another's place.
    pairs = [(f"a{k}", f"b{k}") for k in range(3000)]
    texts = [(k, " ".join(f"{a} {b}" for a, b in pairs)) for k in range(3)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").select(F.col("doc_id"), "text")
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "text", F.lit(False).alias("held_out"))
    model = py._gathered(py._dealt(rows, np.empty(0, np.uint64), np.empty((0, 2), np.uint64), 2), 2)
    found = defaultdict(set)
    for r in model.collect():
        words, contexts, word, context, counts = py._cells(bytes(r.model))
        for w, c, n in zip(words[word].tolist(), contexts[context].tolist(), counts.tolist()):
            found[c].add(w)
            assert n == 3
    assert len(found) == 2 * len(pairs) + 1 and all(len(followers) == 1 for followers in found.values())


def test_tokens_of_a_frequent_pair_meet_nowhere(spark, monkeypatch):
    # A filler pair holds most of the tokens; every document also has words of its own.
    texts = [(k, "again and " * (k % 50 + 200) + f"own{k} word{k % 7}") for k in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "text", F.lit(False).alias("held_out"))
    hashes = py.WordHashes()
    both = hashes.of([b"again", b"and"])
    pairs = np.array(sorted([(both[0], both[1]), (both[1], both[0])]), np.uint64)
    model = py._gathered(py._dealt(rows, np.sort(both), pairs, 5), 5).collect()
    entries = {r.part: py._unpack(bytes(r.tokens)) for r in model}
    # Entries are counted by document; those of the pairs are spread over all further partitions.
    assert sum(len(x[0]) for k, x in entries.items() if k >= 5) == 2 * 400
    assert max(len(x[0]) for k, x in entries.items() if k >= 5) < 2 * 400 / 3
    assert sum(int(x[1].sum()) for x in entries.values()) == sum(len(t.split()) + 1 for _, t in texts)
    found = {}
    for r in model:
        if r.part < 5:
            words, contexts, word, context, counts = py._cells(bytes(r.model))
            found |= {(int(contexts[c]), int(words[w])): int(n) for w, c, n in zip(word, context, counts)}
    assert found[tuple(map(int, both))] == sum(t.count("again") for _, t in texts)
    # Frequent pairs get the scores they have when none is set apart.
    plain = {r.doc_id: r for r in score_texts(docs).collect()}
    monkeypatch.setattr(py, "_pair_places", lambda pairs, before, words: np.full(len(words), -1, np.int64))
    for r in score_texts(docs).collect():
        other = plain[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (other.n_tokens, other.n_known, other.train_tokens)
        assert abs(r.score - other.score) < 1e-6 and abs(r.base_score - other.base_score) < 1e-6


def test_tokens_of_odd_texts_are_those_of_bytes():
    odd = [None, "", "  ", " a  B\x0b\x0cC ", "\x1ca\x1f b c  d", "Ünï É\n\n漢字 x\t", "AA", "\U0001F600 \x85 z", "a\x00b c"]
    words, sizes, hashes = py._numbered(pa.chunked_array([pa.array(odd)]))
    expected = [[*py.WordHashes().of((t or "").encode().lower().split()).tolist(), int(py._END)] for t in odd]
    assert hashes[words].tolist() == sum(expected, []) and sizes.tolist() == [len(e) for e in expected]
    first = np.cumsum(sizes) - sizes
    assert (hashes[py._before(words, sizes)][first] == py._START).all()
    # Runs keep all rows in order; a long text stands alone.
    batches = [pa.record_batch({"text": pa.array(["x" * k for k in ks], pa.string())}) for ks in ([1, 2, 3], [50, 1], [], [0] * 30)]
    runs = [[len(t) for t in r.column("text").to_pylist()] for r in py._runs(iter(batches), 40)]
    assert sum(runs, []) == [1, 2, 3, 50, 1, *[0] * 30] and [50] in runs and max(map(len, runs)) == 6


def test_ranked_words_shrink_what_is_shuffled_and_change_no_cell(spark):
    rng = np.random.default_rng(4)
    texts = [(k, " ".join(f"w{x}" for x in rng.integers(0, 900, 800))) for k in range(120)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "text", (F.col("doc_id") % 10 == 0).alias("held_out")).persist()
    hashes = np.unique(py.WordHashes().of([f"w{x}".encode() for x in range(0, 900, 2)]))
    none, size, found = np.empty((0, 2), np.uint64), [], []
    for ranked in (py._NONE, rng.permutation(hashes)):
        dealt = py._dealt(rows, py._NONE, none, 3, ranked)
        size.append(dealt.agg(F.sum(F.length("data"))).first()[0])
        cells = {}
        for r in py._gathered(dealt, 3, ranked).collect():
            words, contexts, word, context, counts, _ = py._opened(bytes(r.model), ranked)
            in_cell, n, uids = py._unpack(bytes(r.tokens))
            ends = np.cumsum(in_cell)
            for c, w, k, a, b in zip(contexts[context].tolist(), words[word].tolist(), counts.tolist(), ends - in_cell, ends):
                cells[c, w] = (k, sorted(zip(uids[a:b].tolist(), n[a:b].tolist())))
        found.append(cells)
    assert found[0] == found[1] and size[1] < 0.8 * size[0]
    assert sum(n for _, seen in found[0].values() for _, n in seen) == 120 * 801


def test_a_model_leaves_only_its_sums_on_disk(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "scratch_path", lambda spark, name: str(tmp_path / f"{name}-{random.random()}"))
    # Partitions whose tokens are all those of frequent pairs have none of their own.
    docs = spark.createDataFrame([(k, f"one two{k % 7} three") for k in range(90)], "doc_id long, text string")
    rows = score_texts(docs).collect()
    assert len(rows) == 90 and all(r.n_tokens == 4 for r in rows)
    assert {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()} == {"py-rows", "py-sums"}


def test_a_model_that_learned_nothing_gives_probability_one(spark):
    rows = score_texts(spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows) == [(1, 0, 0, 0, 0), (3, 0, 0, 0, 0)]


def test_workers_need_no_package_for_a_model():
    shared = py._Shared(1, py._NONE, np.empty(0), py._NONE)
    assert b"runledger" not in pickle.dumps(py._plain(shared))
    py._ways(0.5)
    assert len(cloudpickle.dumps(py._ways)) < 100_000 and isinstance(cloudpickle.loads(cloudpickle.dumps(py._ways)).__wrapped__(0.5), np.ndarray)


def test_kinds_counts_all_hits_of_a_long_text():
    weights = _Weights({b"=vile": 2.0, b"=foul": 2.0})
    values = dict(zip(FEATURES, features("vile " * 100_001 + "fine foul", weights)))
    assert values["kinds"] == 2 and values["stretch"] == 40


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries()["op10_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in toxic]
    high = [r.score for r in rows if toxic[r.doc_id]]
    low = [r.score for r in rows if not toxic[r.doc_id]]
    assert np.mean([h > x for h in high for x in low]) > 0.85


def test_pipeline_stages_keep_their_promises(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
    mixed = entry.queries()["pipeline"](spark, SF).collect()
    assert all(0 <= r.taken <= 2 * r.size for r in mixed)
    by_source = defaultdict(int)
    for r in mixed:
        by_source[r.source] += r.taken
    assert all(abs(by_source[r.source] - r.target) < 1 for r in mixed)


def test_pipeline_stages_keep_the_right_documents(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(8)

    def text(n):
        return " ".join(f"w{k}" for k in rng.integers(0, 5000, n))

    passage, item = text(60), text(20)
    texts = {k: text(120) for k in range(20)}
    texts |= {20: texts[3], 21: texts[4] + " end", 22: text(30) + "\n" + passage, 23: passage + "\n" + text(40)}
    texts |= {24: text(50) + " " + item + " " + text(50), 25: text(50) + " " + " ".join(item.split()[:9]) + " " + text(50)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(pipeline.STAGES)

    def kept(name):
        return {r.doc_id: r.text for r in stages[name](spark, docs, str(tmp_path)).collect()}

    groups = brute_components(texts, 5, 80)
    near = kept("near_dedup")
    assert near == {k: texts[k] for k in near} and len(near) == len(set(groups.values())) == 24
    assert {groups[k] for k in near} == set(groups.values())
    assert kept("decontamination") == {k: v for k, v in texts.items() if k != 24}
    # The later copy of a line run goes, and a document of which nothing is left.
    assert kept("line_dedup") == {k: v for k, v in texts.items() if k != 20} | {23: texts[23].split("\n")[1]}
