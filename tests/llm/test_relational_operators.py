import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from urllib.parse import urljoin, urlsplit

import pytest

import corpus_pipeline
from voxloom.llm import chat_format, sharding, url_filter

from . import brute

SF = "/root/testdata/sf0.001"


# ---- URL filter


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], "page_id long, url string, html string, host string, verdict string")


def canonical(url):
    return f'<html><head><LINK href="{url}" rel="canonical"></head>'


def refresh(url):
    return f"<meta http-equiv='refresh' content='0; url={url}'>"


def test_rules_and_parts(spark):
    rows = [
        (1, "http://A.example.ORG/en/12?q#f", None), (2, "https://example.org/es/x", ""), (3, "http://x.com/de/1", ""), (4, "http://x.com/fr/", ""), (5, "http://x.net/de/1", ""),
        (6, None, None), (7, "no scheme/en", ""), (8, "http://org", ""), (9, "http://notexample.org/es/", ""), (10, "x://y?a://org/b", ""), (11, "http://example.org#/es/", ""), (12, "", ""),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages(spark, rows)).collect()}
    assert got == {
        1: ("a.example.org", "/en/12", "example.org/en/1", "block"), 2: ("example.org", "/es/x", "example.org/es/", "block"), 3: ("x.com", "/de/1", "com/de/", "block"), 4: ("x.com", "/fr/", "com/fr/", "allow"),
        5: ("x.net", "/de/1", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("org", "", None, "allow"), 9: ("notexample.org", "/es/", "org/", "allow"),
        10: ("y", "", None, "allow"), 11: ("example.org", "", None, "allow"), 12: ("", "", None, "allow"),
    }


def test_blocks_spread_over_aliases_and_allows_take_precedence(spark):
    rows = [
        (1, "http://a.net/1", canonical("http://b.net/2")), (2, "http://b.net/2", refresh("http://x.com/de/9")), (3, "http://b.net/2?utm=1", ""),  # to a blocked url that is no page; another query is another page
        (4, "http://c.net/1", canonical("http://x.com/de/8")), (5, "http://x.com/fr/8", canonical("http://c.net/1")), (6, "http://x.com/de/8", None),  # an allowed page in the component
        (7, "http://d.net/1", canonical("/2")), (8, "http://d.net/2", refresh("http://example.org/es/")), (9, "http://e.net/1", canonical("mailto:x@x.com/de/")), (9, "http://e.net/1", canonical("/go?to=http://x.com/de/")), (10, "HTTP://b.NET/2#top", ""),
    ]
    got = Counter((r.page_id, r.verdict, r.source) for r in url_filter.judge_urls(pages(spark, rows)).collect())
    assert got == Counter([
        (1, "block", "alias"), (2, "block", "alias"), (3, "allow", "default"), (4, "allow", "alias"), (5, "allow", "rule"), (6, "block", "rule"),
        (7, "block", "alias"), (8, "block", "alias"), (9, "allow", "default"), (9, "allow", "default"), (10, "block", "alias"),
    ])


def test_further_edges_and_empty_tables(spark):
    edges = spark.createDataFrame([("http://a.net/", "http://x.com/de/"), (None, "http://x.com/de/"), ("http://z.net", None)], "url string, target string")
    rows = [(1, "http://a.net/", ""), (2, "http://z.net", "")]
    assert {(r.page_id, r.verdict) for r in url_filter.judge_urls(pages(spark, rows), edges=edges).collect()} == {(1, "block"), (2, "allow")}
    assert url_filter.judge_urls(pages(spark, []), edges=edges).count() == 0


BASES = ["http://x.com/a/b/c.html?q=1#f", "https://X.com", "http://x.com/", "http://x.com/a/", "http://x.com?x/y"]
TARGETS = ["//h.org/p", "/r", "page.html", "../up", "../../../up", "./here/", "?p=1", "HTTP://Other.NET/x/../y/./z?k=a/../b", "a/b/..", ".", "..", "x?to=http://z.com/de/", "https://other.net", "/a/./b//c", "..."]


def test_markup_that_is_no_markup_links_nothing(spark):
    away = '<meta http-equiv="refresh" content="0;url=http://z.com/de/">'
    texts = [f"<!-- {away} -->", f"<script>var x = '{away}';</script>", f"<template>{away}</template>", f"<!-- open {away}", f"<title>{away}</title>", f"<style>{away}</STYLE >", away, f"<!-- closed -->{away}"]
    rows = [(k, f"http://a{k}.com/x", t) for k, t in enumerate(texts)]
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: "block" if k > 5 else "allow" for k in range(8)}


def test_ports_that_a_scheme_implies(spark):
    rows = [(1, "HTTP://A.com:80/x", None), (2, "http://a.com/x", '<link rel="canonical" href="http://z.com/de/">'), (3, "https://a.com:443/y", None), (4, "http://a.com:8080/x", None), (None, None, None), (None, "no scheme", None)]
    log = spark.createDataFrame([("https://a.com/y", "http://z.com/de/")], "url string, target string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), edges=log).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", None: "allow"}


def test_targets_resolve_as_urljoin_does(spark):
    rows = [(b, t) for b in BASES for t in TARGETS]
    out = spark.createDataFrame(rows, "url string, target string").select("url", "target", url_filter.url_node(url_filter.resolved(chat_format.F.col("target"), chat_format.F.col("url"))).alias("node")).collect()
    for r in out:
        want = urlsplit(urljoin(r.url, r.target))
        path = urlsplit(urljoin(f"http://x{want.path or '/'}", "")).path
        path = urljoin(f"http://x{path}", path).removeprefix("http://x")  # dot segments of a whole URL too
        assert r.node == f"{want.scheme}://{want.netloc.lower()}{path or '/'}" + (f"?{want.query}" if want.query else ""), (r.url, r.target)
    nowhere = spark.createDataFrame([("http://x.com/", t) for t in ("#f", "", "mailto:a@b.c", "javascript:void(0)", None)] + [(None, "/a"), ("x", "/a")], "url string, target string")
    assert {r[0] for r in nowhere.select(url_filter.resolved(chat_format.F.col("target"), chat_format.F.col("url"))).collect()} == {None}


def test_aliases_match_brute_force(spark):
    """Pages linked by canonical links, refreshes and a redirect log, a hub that very many redirect to, and a long page."""
    rng = random.Random(6)
    sites = ["a.net", "x.com", "b.example.org", "c.org"]
    url = lambda: f"http://{rng.choice(sites)}/{rng.choice(['de', 'fr', 'es', 'en', 'p'])}/{rng.randrange(60)}"
    rows = [(i, url(), rng.choice([None, "", canonical(url()), refresh(f"/p/{rng.randrange(60)}"), canonical("1"), "x" * 200 + refresh(url())])) for i in range(150)]
    rows += [(1000 + i, f"http://hub{i}.net/", refresh("http://login.net/in")) for i in range(100)] + [(2000, "http://login.net/in", "y" * 400_000 + canonical("http://x.com/de/9")), (2001, None, canonical("http://x.com/de/9"))]
    log = [(url(), url()) for _ in range(30)] + [(None, url()), (url(), None)]
    links = [(u, t) for _, u, h in rows if u and h for t in re.findall(r"(?:url=|href=\")([^\"']+)", h)] + [x for x in log if None not in x]
    edges = {(u, urljoin(u, t)) for u, t in links}
    roots = brute.components({n for e in edges for n in e}, edges)

    def rule(u):
        host, _, path = (u or "").partition("://")[2].partition("/")
        fits = [(len(text), text, kind) for kind, text in url_filter.RULES for site, _, start in [text.partition("/")] if (host == site or host.endswith("." + site)) and ("/" + path).startswith("/" + start)]
        return max(fits)[1:] if fits and host else (None, None)

    passed = defaultdict(set)
    for node, root in roots.items():
        passed[root].add(rule(node)[1])
    want = []
    for i, u, _ in rows:
        text, kind = rule(u)
        told = passed[roots[u]] - {None} if u in roots else set()
        want.append((i, text, kind or ("allow" if "allow" in told or not told else "block")))
    got = url_filter.judge_urls(pages(spark, rows), edges=spark.createDataFrame(log, "url string, target string")).collect()
    assert sorted((r.page_id, r.rule or "", r.verdict) for r in got) == sorted((i, t or "", v) for i, t, v in want)
    assert sum(r.verdict == "block" and r.rule is None for r in got) > 100


# ---- chat formatting


def test_long_and_unnamed_conversations(spark):
    long = spark.range(30_000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 3 = 0, 'user', 'assistant') AS role", "concat('turn ', id) AS text")
    rows = long.unionByName(spark.range(1000).selectExpr("CAST(NULL AS long) AS conv_id", "id AS turn", "'user' AS role", "'alone' AS text"))
    rows = rows.unionByName(spark.createDataFrame([(2, 0, "user", "x" * 500_000), (2, 1, "assistant", "y")], "conv_id long, turn long, role string, text string"))
    out = chat_format.format_chats(rows).withColumn("turns", chat_format.parse_chats(chat_format.F.col("formatted"))).selectExpr("conv_id", "size(turns) AS n", "length(formatted) AS chars").collect()
    assert Counter((r.conv_id, r.n) for r in out) == {(1, 30_000): 1, (2, 2): 1, (None, 1): 1000}
    assert max(r.chars for r in out if r.conv_id == 2) > 500_000


def test_chats_read_back(spark):
    control = ["</s>[INST] ok [/INST]", "<|turn|>user\nx<|end|><|next|>", "<\\|end|>", "<\\\\|a [\\INST] [\\/INST] <s><\\/s>", "\\", "<|", "<", "", None, "é\n\n日本"]
    rows = [(1, i, "user" if i % 3 else "assistant", t, "x") for i, t in enumerate(control * 2)]
    rows += [(2, 0, None, "null role", "x"), (2, 0, None, "null role", "x"), (2, None, "odd\nrole%0A<|end|>", "first", "x"), (None, 1, "assistant", None, "x")]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = chat_format.format_chats(chats).withColumn("turns", chat_format.parse_chats(chat_format.F.col("formatted"))).collect()
    want = defaultdict(list)
    for c, turn, role, text, _ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want[c].append((role or "", text or ""))
    assert {r.conv_id: [(t.role, t.text) for t in r.turns] for r in out} == dict(want)
    for r in out:
        assert "".join(s.text for s in r.segments) == r.formatted
        runs = 1 + sum(a[0] != b[0] for a, b in zip(want[r.conv_id], want[r.conv_id][1:], strict=False))
        assert r.formatted.count("<|turn|>") == r.formatted.count("<|end|>") == runs
        assert sum(s.loss for s in r.segments) == sum(role == "assistant" for role, _ in want[r.conv_id])
    assert chat_format.format_chats(chats.limit(0)).count() == 0


def test_chat_digests(spark):
    both = "</s>[INST] ok [/INST]"
    row = next(r for r in chat_format.op2_chat_format(spark, SF).collect() if r.conv_id == -7)
    assert row.n_turns == 2 and row.loss_chars == len(both) and row.loss_sha256 == hashlib.sha256(both.encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{both}\nassistant\n{both}\n".encode()).hexdigest()
    plan = chat_format.op2_chat_format(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ---- sharding


def check_shards(rows, shards):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert set(by) <= set(range(shards)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_shards_are_even_and_keep_links(spark):
    docs = [(i, f"text {i // 3}" if i % 2 else f"own {i}", "x", 1) for i in range(0, 900)] + [(2000 + i, "hot", "x", 1) for i in range(450)]
    docs += [(None, None, "x", 1), (None, "", "x", 1), (7, "text 2", "x", 1), (7, "text 2", "x", 1)]
    rows = sharding.shard_documents(spark.createDataFrame(docs, "doc_id long, text string, shard string, slot int"), 10, 5).collect()
    assert len(rows) == len(docs)
    check_shards(rows, 10)
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in docs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    groups, shard = defaultdict(list), defaultdict(list)
    for r in rows:
        shard[r.text_crc32].append(r.shard)
    small = [v for k, v in shard.items() if 2 <= len(v) <= 4]
    together = sum(len(set(v)) == 1 for v in small)
    assert together > 0.8 * len(small)
    assert groups == {}


def test_groups_that_fit_a_shard_are_not_cut(spark):
    sizes = [90, 80, 80, 60, 40, 30, 15]
    docs = [(i, f"own {i}") for i in range(400)] + [(1000 * k + i, f"group {k}") for k, size in enumerate(sizes, 1) for i in range(size)]
    docs += [(20_000 + i, f"own too {i}") for i in range(1000 - len(docs))]
    rows = sharding.shard_documents(spark.createDataFrame(docs, "doc_id long, text string"), 10).collect()
    check_shards(rows, 10)
    shards = defaultdict(set)
    for r in rows:
        shards[r.text_crc32].add(r.shard)
    assert [len(shards[zlib.crc32(f"group {k}".encode())]) for k in range(1, len(sizes) + 1)] == [1] * len(sizes)


def test_rows_that_repeat_id_and_text_are_told_apart(spark):
    rows = [(None, "same")] * 600 + [(7, "other")] * 300 + [(k, f"text {k}") for k in range(100)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 10).collect()
    held = {}
    for r in got:
        held.setdefault(r.shard, []).append(r.slot)
    assert {s: sorted(x) for s, x in held.items()} == {s: list(range(100)) for s in range(10)}
    # six hundred copies fill six shards but for what others level, not a bucket of one
    assert 6 <= len({r.shard for r in got if r.doc_id is None}) <= 10


def test_nothing_to_shard_or_to_cut(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, shard int")
    assert sharding.cut_links(sharding.shard_documents(empty)).collect() == []
    sharding.write_shards(empty, str(tmp_path / "none"))
    assert spark.read.schema("doc_id long").parquet(str(tmp_path / "none")).count() == 0


def test_shards_of_few_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    check_shards(sharding.shard_documents(docs).collect(), 40)
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_write_shards_keeps_every_row(spark, tmp_path):
    rows = [(i, f"t{i}", i) for i in range(50)] + [(None, "t1", 1), (None, "t1", 1), (None, None, 2), (3, "t3", 3), (3, "other", 4), (60, "long " * 60_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot int")
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((d, t) for d, t, _ in rows)
    check_shards(back, 4)


def random_pieces(seed, shards=6):
    rng = random.Random(seed)
    return [(b, s, rng.randrange(1, 6), s) for b in range(60) for s in rng.sample(range(shards), rng.randrange(1, 5))]


def links_cut(pieces):
    """(block, start, count, shard): pairs of rows of one block that lie in different shards."""
    held = defaultdict(Counter)
    for block, _, count, shard in pieces:
        held[block][shard] += count
    return sum((sum(c.values()) ** 2 - sum(n * n for n in c.values())) // 2 for c in held.values())


@pytest.mark.parametrize(("seed", "bucket_rows"), [(1, 1000), (2, 7)])
def test_one_round_of_propagation_matches_brute_force(spark, seed, bucket_rows):
    pieces, room = random_pieces(seed), [40, 0, 5, 100, 12, 0]
    asks = sharding.ask(spark.createDataFrame(pieces, "block long, start int, count long, shard int"), room).cache()
    held = defaultdict(Counter)
    for block, _, count, shard in pieces:
        held[block][shard] += count
    want = {}
    for block, spread in held.items():
        if most := max((n for s, n in spread.items() if room[s]), default=0):
            want[block] = ({s for s, n in spread.items() if room[s] and n == most}, most)
    got = defaultdict(dict)
    for r in asks.collect():
        got[r.block][r.shard] = (r.target, r["count"])
    for block, spread in held.items():
        targets = {t for t, _ in got[block].values()}
        if block not in want:
            assert not targets
            continue
        best, most = want[block]
        assert len(targets) <= 1 and targets <= best
        if targets:
            target = targets.pop()
            assert got[block] == {s: (target, n) for s, n in spread.items() if s != target and n <= most}
        else:
            assert not [s for s, n in spread.items() if n <= most and s not in best] and len(best) == 1
    admitted = sharding.admit(asks, room, 0, bucket_rows).collect()
    wanted, let = Counter(), Counter()
    for r in asks.collect():
        wanted[r.target] += r["count"]
    for r in admitted:
        let[r.target] += r["count"]
    assert all(let[s] <= room[s] for s in range(6))
    # an ask is refused only where its running total exceeds the room, so what is left over is less than the next ask
    assert all(let[s] == wanted[s] if wanted[s] <= room[s] else let[s] > room[s] - 6 for s in range(6))


def test_propagation_cuts_fewer_links_and_respects_capacity(spark):
    pieces = random_pieces(3)
    load = Counter()
    for _, _, count, shard in pieces:
        load[shard] += count
    held, capacity = [5, 0, 0, 0, 0, 3], [load[s] + 15 for s in range(6)]
    out = [tuple(r) for r in sharding.propagate(spark.createDataFrame(pieces, "block long, start int, count long, shard int"), held, capacity, 4).collect()]
    after = Counter()
    for _, _, count, shard in out:
        after[shard] += count
    assert sorted(x[:3] for x in out) == sorted(x[:3] for x in pieces)
    assert all(after[s] + held[s] <= capacity[s] for s in range(6))
    assert links_cut(out) < links_cut(pieces) / 2


def test_cut_links_are_counted_by_group_size(spark):
    docs = [(i, f"text {i // 3}") for i in range(300)] + [(1000 + i, f"own {i}") for i in range(300)] + [(2000 + i, "hot") for i in range(150)]
    placed = sharding.shard_documents(spark.createDataFrame(docs, "doc_id long, text string"), 10, bucket_rows=20).cache()
    check_shards(placed.collect(), 10)
    got = {r["rows"]: (r.groups, r.links, r.cut) for r in sharding.cut_links(placed).collect()}
    held = defaultdict(Counter)
    for r in placed.collect():
        if r.linked:
            held[r.group][r.shard] += 1
    want = defaultdict(lambda: [0, 0, 0])
    for c in held.values():
        n = sum(c.values())
        row = want[n]
        row[0], row[1], row[2] = row[0] + 1, row[1] + n * (n - 1) / 2, row[2] + n * (n - 1) / 2 - sum(k * (k - 1) / 2 for k in c.values())
    assert got == {n: tuple(v) for n, v in want.items()}
    assert got[3][2] < 0.1 * got[3][1] and got[150][2] < 0.7 * got[150][1]


# ---- pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        assert 0 < docs.count() <= n
        n = docs.count()
    assert corpus_pipeline.run(spark, SF).count() == n
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "decontamination", "bpe_encode"]


ODD = [
    (None, "a null id with words enough to be told as English, and more of them to go on with"), (1, None), (2, ""), (3, " \n\t "), (4, "12 34"), (5, "the same words are here again and again for all of them to see"),
    (5, "the same words are here again and again for all of them to see"), (5, "another text of the same id, which has words of its own too"), (6, "word by word " * 30_000), (None, None), (None, None),
]


@pytest.mark.parametrize("rows", [ODD, []])
def test_pipeline_stages_of_odd_rows_and_clashing_names(spark, tmp_path, rows):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names = "lang string, source string, n_chars long, _row int, _id long, _hash string, _drop int, node string, root int, row int, ranges int, first string, b1 int, text_hash string"
    table = [(d, t, "en", "s", 1, 1, 2, "x", 3, "n", 4, 5, 6, "f", 7, "h") for d, t in rows]
    docs = spark.createDataFrame(table, "doc_id long, text string, " + names)
    want = {"language_id": [None, 5, 5, 5, 6], "simhash_dedup": [None, 1, 4, 5, 5, 6], "decontamination": [d for d, _ in ODD]}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        got = [r.doc_id for r in out.collect()]
        assert name == "bpe_encode" or out.columns == docs.columns
        if name == "line_dedup":
            # the second row of a repeated document keeps the lines of the first
            assert len(got) == len(rows)
        elif name != "bpe_encode" and rows:
            assert sorted(got, key=str) == sorted(want[name], key=str), name
        else:
            assert len(got) == len(rows)
