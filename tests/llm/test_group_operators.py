"""Operators that shuffle, against brute force."""

import collections
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from slotwise.llm import line_dedup, ngram_join, packing, warc, wrapper
from slotwise.llm.queries import tokenizer_files


def shingle_sets(texts):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        out.append(set(zip(w, w[1:], w[2:])) if len(w) > 2 else {tuple(w)} if w else set())
    return out


def brute_components(sets, percent=90):
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(sets))]


def test_jaccard_components(spark):
    rnd = random.Random(4)
    texts = [None, "", "one", "One", "one two", "one  two\n", "a b c", "A B c"]
    for n in (9, 12, 16, 24, 40, 75, 150, 400):
        base = [f"w{rnd.randrange(5000)}" for _ in range(n + 2)]
        for _ in range(14):
            w = base[:]
            for _ in range(rnd.randint(0, max(1, n // 40))):
                w[rnd.randrange(len(w))] = f"v{rnd.randrange(10**6)}"
            texts.append(" ".join(w[: len(w) - rnd.randint(0, max(1, n // 20))]))
    rnd.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("node", F.lit("clash"))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df).collect())
    sets = shingle_sets(texts)
    assert got == [(i, len(sets[i]), c) for i, c in enumerate(brute_components(sets))]
    assert len({c for *_, c in got}) < len(texts) - 20


@pytest.mark.parametrize("block_rows", [1, 2, 1000])
def test_jaccard_hot_keys_in_cells(spark, block_rows):
    rnd = random.Random(12)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(40):  # many keys of many nodes, and several components beside the centre's
        w = base[:]
        for k in rnd.sample(range(300), rnd.choice([1, 2, 3, 4, 5])):
            w[k] = f"v{rnd.randrange(10**6)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in ngram_join.near_duplicates(df, block_rows=block_rows).collect())
    assert got == list(enumerate(brute_components(shingle_sets(texts))))


def test_pipeline_links_five_words_at_four_fifths(spark):
    rnd = random.Random(9)
    texts = ["", "one two three", "One two three", "a b c d e", "a b c d f"]
    for n in (12, 30, 60, 150, 400):
        base = [f"w{rnd.randrange(5000)}" for _ in range(n)]
        for share in (0, 0.02, 0.05, 0.1, 0.14, 0.18, 0.25, 0.4):
            k = int(n * share)
            texts.append(" ".join(base + [f"x{rnd.randrange(10**6)}" for _ in range(k)]))
            texts.append(" ".join(base[k:]))
            w = base[:]
            for _ in range(k // 5):
                w[rnd.randrange(n)] = f"v{rnd.randrange(10**6)}"
            texts.append(" ".join(w))
    rnd.shuffle(texts)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    words = [t.lower().split() for t in texts]
    sets = [set(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else {tuple(w)} if w else set() for w in words]
    wide = brute_components(sets, 80)
    stay = [i for i, c in enumerate(wide) if i == c]
    assert stay != [i for i, c in enumerate(brute_components(shingle_sets(texts))) if i == c]
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == stay


def test_jaccard_without_rows(spark):
    assert ngram_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(8)
    for percent in (80, 90):
        for lo, hi, m, d in ngram_join.bands(6000, percent):
            assert m + d > ngram_join.differing(hi, hi, percent) and d <= m
        for n in [*range(1, 60), 77, 130, 255, 700, 1999, 5000]:
            for _ in range(4):
                # the least common part that two sets of sizes n and `other` need
                other = int(rng.integers(n, n * 100 // percent + 1))
                common = -(-percent * (n + other) // (100 + percent))
                x = rng.integers(1, 1 << 63, n + other - common, dtype=np.uint64)
                sets = [np.sort(x[:n]), np.sort(x[n - common :])]
                sizes = np.array([len(s) for s in sets])
                assert 100 * common >= percent * (sum(sizes) - common)
                keys, counts = ngram_join.set_keys(np.concatenate(sets), np.repeat([0, 1], sizes), sizes, percent)
                if n < other or sets[0].tolist() != sets[1].tolist():
                    assert set(keys[: counts[0]]) & set(keys[counts[0] :])


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate({97: 98, 98: 97})
    return word


def test_words_that_polynomial_hashes_confuse(spark):
    a = thue_morse(1024)
    b = a.translate({97: 98, 98: 97})
    df = spark.createDataFrame([(0, f"{a} x y z"), (1, f"{b} x y z"), (2, f"{b} x y Z")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in ngram_join.near_duplicates(df).collect()) == [(0, 0), (1, 1), (2, 1)]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def mutate(rnd, text, k):
    x = list(text)
    for _ in range(k):
        i = rnd.randrange(len(x) + 1)
        kind = rnd.random()
        if kind < 0.33:
            x.insert(i, rnd.choice("abé"))
        elif kind < 0.66 and x:
            x.pop(min(i, len(x) - 1))
        elif x:
            x[min(i, len(x) - 1)] = rnd.choice("abé")
    return "".join(x)


@pytest.mark.parametrize("tau", [1, 2])
def test_lines(spark, tau):
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(15, 50))) for _ in range(30)]
    docs = [(i, "\n".join(mutate(rnd, rnd.choice(base), rnd.choice([0, 0, 1, 2, 3, 5])) for _ in range(rnd.randint(1, 5)))) for i in range(60)]
    docs += [(70, None), (71, ""), (72, "\n\n"), (None, base[0] + "\nshort\nshort"), (73, base[0]), (73, base[0])]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, Lines_Removed string").withColumns({c: F.lit(1) for c in ("_doc", "_gone", "h", "line")})
    key = lambda d: -1 if d is None else d
    lines = sorted({(key(d), p, x) for d, t in docs if t is not None for p, x in enumerate(t.split("\n"))})
    gone = set()
    for i, (d, p, x) in enumerate(lines):
        for d2, p2, x2 in lines[:i]:
            same = x == x2 and len(x.strip(" ")) >= 10
            if (d2, p2) != (d, p) and (same or min(len(x), len(x2)) >= 24 and abs(len(x) - len(x2)) <= tau and edit_distance(x, x2) <= tau):
                gone.add((d, p))
                break
    want = sorted((key(d), None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (key(d), p) not in gone)) for d, t in docs)
    for kw in ({}, {"broadcast_rows": 0}):
        rows = line_dedup.dedup_lines(df, tau=tau, **kw).collect()
        assert sorted((key(r.doc_id), r.text) for r in rows if r.text is not None) == [w for w in want if w[1] is not None]
        assert sum(r.text is None for r in rows) == 1 and len(rows) == len(docs)


def test_padded_lines_stay(spark):
    padded = [" " * 30, " " * 29 + "}", "   " * 9 + "short" + " " * 5, " " * 24]
    texts = ["\n".join([*padded, f"line number {i} of its own text {i * 7919}"]) for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in line_dedup.dedup_lines(df).collect():
        assert r.text.split("\n")[:4] == padded


def test_line_dedup_is_native(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    plan = line_dedup.dedup_lines(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_packing(spark):
    rnd = random.Random(6)
    texts = [None, "", "a", "<|endoftext|> x", "  lead  and   more ", "é x\n\n y"] + ["word " * rnd.randint(1, 700) for _ in range(150)] + ["tok " * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("offset", F.lit("clash"))
    files = tokenizer_files()
    rows = packing.pack(df, **files, bucket_rows=20).collect()
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(files["tokenizer"])
    pieces = collections.defaultdict(dict)
    bins = collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id][r.piece] = r
        bins[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate(texts):
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for k in range(len(pieces[i])):
            r = pieces[i][k]
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert r.length <= 2048 and (len(pieces[i]) == 1 or k == 0 or r.length == 2048)
            at += r.length
        assert at == len(ids)
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(r.length for r in rows) // 2048) + 1
    assert packing.pack(df.limit(0), **files).count() == 0


def test_histogram_packing_is_optimal_on_small_cases():
    rnd = random.Random(7)

    def fewest(sizes, room):
        best = len(sizes)

        def put(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(sizes):
                best = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + sizes[i] <= room and bins[k] not in bins[:k]:
                    put(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
            put(i + 1, [*bins, sizes[i]])

        put(0, [])
        return best

    for k in range(1000):
        room = (20, 100)[k % 2]
        sizes = sorted((rnd.randint(1, room) if k % 3 else rnd.randint(room // 10, room * 6 // 10) for _ in range(rnd.randint(1, 14))), reverse=True)
        made, proved = packing.pack_histogram(collections.Counter(sizes), room)
        assert sorted((s for n, f in made for s in f * n), reverse=True) == sizes and all(sum(f) <= room for _, f in made)
        least = fewest(sizes, room)
        assert packing.lower_bound(collections.Counter(sizes), room) <= least
        assert proved and sum(n for n, _ in made) == least
    made, proved = packing.pack_histogram(dict.fromkeys([58, 55, 52, 38, 30, 18, 17, 16, 12], 1), 100)
    assert proved and sum(n for n, _ in made) == 3
    # of many sequences, those of most waste are packed anew
    made, proved = packing.pack_histogram({58: 50, 55: 50, 52: 50, 38: 50, 30: 50, 18: 50, 17: 50, 16: 50, 12: 50}, 100)
    assert 150 <= sum(n for n, _ in made) < 157 and sum(n * len(f) for n, f in made) == 450 and not proved


def test_long_runs_of_white_space():
    from tokenizers import Tokenizer

    files = tokenizer_files()
    encode = packing.Tokens(files["tokenizer"], files["ranks"], files["pattern"])
    whole = Tokenizer.from_file(files["tokenizer"])
    for text in (" " * 2_000_000, "a" + "\n" * 30_000 + "b", " " * 19_999 + "x"):
        assert encode(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing_of_many_empty_texts(spark):
    texts = ["", None] * 2500 + ["word " * 1500, "word " * 600]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bins = collections.defaultdict(list)
    for r in packing.pack(df, **tokenizer_files()).collect():
        bins[r.sequence_id].append((r.offset, r.length))
    assert sum(map(len, bins.values())) == len(texts)
    for places in bins.values():
        assert [o for o, _ in sorted(places)] == [sum(n for _, n in sorted(places)[:i]) for i in range(len(places))] and sum(n for _, n in places) <= 2048
    assert len(bins) == -(-sum(n for p in bins.values() for _, n in p) // 2048)
    assert packing.pack_histogram({1: 100_000}, 50_000) == ([(2, (1,) * 50_000)], True)


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "x" * 1500 + "é</p>"
    rows = [(1, "http://a/1", big), (2, None, big), (3, "http://a/3\r\nx", "small"), (4, "http://a/4", "small"), (5, "u", None), (6, "u", ""), (7, "u", big), (7, "u", big), (8, "v", "y" * 200_000), (None, "w", big)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload_digest string").repartition(3)
    index = warc.write_warc(pages, tmp_path.as_uri())
    for kw in ({}, {"gap": 0, "most": 1000}):
        got = sorted(((r.page_id, r.url, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_warc(index, **kw).collect()), key=str)
        n = len(big.encode())
        want = sorted([(1, "http://a/1", n, "revisit", 7), (2, None, n, "revisit", 7), (3, "http://a/3 x", 5, "response", None), (4, "http://a/4", 5, "response", None), (5, "u", 0, "response", None), (6, "u", 0, "response", None), (7, "u", n, "response", None), (7, "u", n, "response", None), (8, "v", 200_000, "response", None), (None, "w", n, "revisit", 7)], key=str)
        assert got == want
    # each member is a record that says its own length, with an HTTP message in it
    one = index.where("page_id = 8").first()
    with open(one.archive.removeprefix("file://"), "rb") as f:
        f.seek(one.offset)
        head, _, block = zlib.decompress(f.read(one.length), 31).partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    assert head.startswith(b"WARC/1.1\r\n") and len(block) == int(fields["Content-Length"]) + 4 and block.startswith(b"HTTP/1.1 200 OK\r\n") and re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", fields["WARC-Record-ID"])
    some = warc.read_warc(index.where("page_id = 8")).first()
    assert some.payload.decode() == "y" * 200_000
    assert warc.write_warc(pages.limit(0), (tmp_path / "none").as_uri()).count() == 0


PAGE = """<html><head><title>t</title><style>p{{}}</style></head><body><div>Our great site</div><nav><a href=/>home {i}</a></nav>
<div class="ad">buy {i}</div><div><p>First &amp; second<br>of {i}</p><p>Share this now</p><p><b>third {i}</div><aside>see {i}</aside>
<div id="comments"><p>nice {i}</p></div><form><p>mail {i}</p></form><script>var x="<p>{i}</p>"</script><footer>&copy; {i}</footer></body></html>"""


def test_wrapper_learns_what_a_host_repeats(spark):
    rows = [(i, "http://h.example/p", PAGE.format(i=i)) for i in range(12)] + [(50, None, "<p>alone</p>tail"), (51, "http://x/", None), (52, "http://x/", ""), (53, "http://y/", "<article><header><h1>T</h1></header>a<p>b</article><p>out")]
    rows += [(60, "http://z/", "<div>" * 5000 + "deep" + "</div>" * 5000), (61, "http://z/", "".join(f"<p>{k}</p>" for k in range(3000)))]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    for kw in ({}, {"broadcast_bytes": 1}):
        got = {r.page_id: r.text for r in wrapper.extract(df, **kw).collect()}
        assert all(got[i] == f"First & second of {i}\nthird {i}" for i in range(12))
        assert (got[50], got[51], got[52], got[53], got[60]) == ("alone\ntail", "", "", "T\na\nb", "deep")
        assert got[61] == "\n".join(map(str, range(3000)))
    assert wrapper.extract(df.limit(0)).count() == 0


def test_wrapper_keeps_text_of_copies(spark):
    page = lambda k, n: "<body><div>Our site</div>" + "".join(f"<p>{k} says {j}</p>" for j in range(n)) + "</body>"
    rows = [(i, "http://copies/", page("same", 3)) for i in range(9)] + [(9, "http://copies/", page("other", 3)), (9, "http://copies/", page("other", 3))]
    # long pages with copies: few pages reach their later paragraphs
    rows += [(100 + i, "http://long/", page(f"long{i % 4}", 40)) for i in range(24)] + [(200 + i, "http://long/", page(f"p{i}", 2)) for i in range(12)]
    # two pages of another kind lack what all others repeat
    rows += [(300 + i, "http://odd/", page(f"q{i}", 2) if i % 8 else f"<table><tr><td>error {i}</table>") for i in range(16)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for kw in ({}, {"broadcast_bytes": 1}):
        got = {r.page_id: r.text for r in wrapper.extract(df, **kw).collect()}
        says = lambda k, n: "\n".join(f"{k} says {j}" for j in range(n))
        assert got[0] == "Our site\n" + says("same", 3) and got[9] == "Our site\n" + says("other", 3)
        assert all(got[100 + i] == says(f"long{i % 4}", 40) for i in range(24))
        assert all(got[200 + i] == says(f"p{i}", 2) for i in range(12))
        assert all(got[300 + i] == (says(f"q{i}", 2) if i % 8 else f"error {i}") for i in range(16))


def random_tree(rnd, depth):
    kids = "".join(random_tree(rnd, depth - 1) for _ in range(rnd.randint(0, 4))) if depth else ""
    return rnd.choice([f"<div>{kids}</div>", f"<section>{kids}</section>", f"<p>{rnd.choice(['x', 'y', 'z z'])}</p>", "<hr>", f"<div>{rnd.choice('xy')}</div>", rnd.choice("xy") + "<div></div>"])


def test_alignment_against_brute_force(monkeypatch):
    rnd = random.Random(13)

    def weight(x, y):
        if x.label != y.label:
            return 0
        if x.tag == "#text":
            return 1 + (x.text == y.text)

        def best(i, j):
            if i == len(x.kids) or j == len(y.kids):
                return 0
            return max(best(i + 1, j), best(i, j + 1), weight(x.kids[i], y.kids[j]) + best(i + 1, j + 1))

        return 1 + best(0, 0)

    for k in range(150):
        a, b = (wrapper.parse("".join(random_tree(rnd, 2) for _ in range(rnd.randint(1, 4)))) for _ in range(2))
        if len(wrapper.nodes_of(a)) > 30 or len(wrapper.nodes_of(b)) > 30:
            continue
        want = weight(a, b)
        monkeypatch.setattr(wrapper.Alignment, "small", wrapper.Alignment.large if k % 2 else wrapper.Alignment.small, raising=True)
        monkeypatch.setattr(wrapper, "_CELLS", 3 if k % 3 else 1 << 22)
        made = wrapper.Alignment(a, b)
        assert made.weight == want == sum(1 + (x.tag == "#text" and x.text == y.text) for x, y in made.pairs)
        place = {id(n): i for t in (a, b) for i, n in enumerate(wrapper.nodes_of(t))}
        order = sorted((place[id(x)], place[id(y)]) for x, y in made.pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(order, order[1:], strict=False))
        monkeypatch.undo()


def test_wrapper_needs_no_names(spark):
    """Blocks without telling elements, classes or ids: only what the host's pages share and vary tells the text."""
    rnd = random.Random(14)
    say = lambda n: " ".join("".join(rnd.choice("abcdefg") for _ in range(6)) for _ in range(n))
    rows, want = [], {}
    for i in range(20):
        title, paragraphs = say(4), [say(30) for _ in range(rnd.randint(2, 6))]
        link = f'<p><a href="/{i}">{say(3)}</a></p>' if i % 2 else ""
        body = "".join(f"<p>{x}</p>" for x in paragraphs) + link
        rows.append((i, "http://plain.example/a", f'<div><div>Welcome to the site</div><div><a href="/">one</a></div></div><div class="post-{i} widget"><h1>{title}</h1><div>{body}</div></div><div><div>{say(3)}</div><div>All rights kept by us</div></div>'))
        want[i] = "\n".join([title, *paragraphs, *([re.sub("<[^>]*>", "", link)] if link else [])])
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for kw in ({}, {"broadcast_bytes": 1}):
        assert {r.page_id: r.text for r in wrapper.extract(df, **kw).collect()} == want
    alone = {r.page_id: r.text for r in wrapper.extract(df.withColumn("url", F.concat(F.lit("http://h"), F.col("page_id"), F.lit(".example/")))).collect()}
    assert alone[0] != want[0]  # one page a host: nothing tells template from text


def test_scanner_is_linear():
    for source in ('<a "' * 250_000, "<a \"x'>" * 150_000, '<a ">"' * 170_000, "<!--" * 250_000, "<" * 1_000_000, "<div>" * 100_000 + "</td>" * 100_000, "<p>" * 100_000 + "</b>" * 100_000, "<a '>" + '<b ">' * 100_000):
        begun = time.time()
        wrapper.parse(source)
        assert time.time() - begun < 5
    for source, text in (('<p title="a>b">x</p>', "x"), ("<p title='a\"b'>x", "x"), ('<p title="a>x</p>y', "x\ny"), ("a < b <p>c", "a < b\nc"), ("<!-- <p>n</p> -->x<!--", "x"), ("x<p", "x<p")):
        assert wrapper.text_alone(wrapper.parse(source), set()) == text, source
    deep = "<div>" * 20_000 + "t" + "</div>" * 20_000
    long = "".join(f"<p>{i % 7} {i}</p>" for i in range(3000))
    other = "".join(f"<p>{i % 7} {i}</p>" for i in range(500, 3400, 2))
    assert wrapper.Alignment(wrapper.parse(deep), wrapper.parse(deep)).weight == 20_000 + 3
    p, q = ([x.text for x in wrapper.leaves(wrapper.parse(s))] for s in (long, other))
    row = [0] * (len(q) + 1)
    for x in p:
        before, row[0] = row[:], 0
        for j, y in enumerate(q, 1):
            row[j] = max(before[j], row[j - 1], before[j - 1] + 2 + (x == y))
    assert wrapper.Alignment(wrapper.parse(long), wrapper.parse(other)).weight == 1 + row[-1]


def test_long_texts_with_a_common_half_are_told_apart_by_sketches(spark, monkeypatch):
    """Each pair shares some keys but no link; before sketches as large as the sets, all 276 pairs were compared word by word."""
    rnd = random.Random(5)
    word = lambda: f"w{rnd.randrange(10**6)}"
    common = [word() for _ in range(1_000)]
    texts = [" ".join(common + [word() for _ in range(500 + 20 * i)]) for i in range(24)]
    near = texts[23].split()
    near[700:702] = ["x", "y"]
    df = spark.createDataFrame([*enumerate(texts), (24, " ".join(near)), (25, None)], "doc_id long, text string")
    compared = []
    verified = ngram_join.verified

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(ngram_join, "verified", counted)
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(df, width=5, percent=80).collect()}
    assert got == {i: 23 if i == 24 else i for i in range(26)}
    assert sum(compared) <= 10


def test_fine_sketches_never_differ_by_more_than_the_sets():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n, common = int(rng.integers(257, 1_500)), rng.integers(0, 1 << 62, 1_500).astype(np.uint64)
        sets = [np.unique(np.concatenate([common[:n], rng.integers(0, 1 << 62, int(rng.integers(0, 250))).astype(np.uint64)])) for _ in range(2)]
        found, row = np.concatenate(sets), np.repeat([0, 1], [len(x) for x in sets])
        words, counts = ngram_join.fine_sketches(found, row, np.bincount(row))
        a, b = np.split(words, [counts[0]])
        halves = lambda z, k: z if len(z) <= k else z[: len(z) // 2] ^ z[len(z) // 2 :]
        a, b = halves(a, len(b)), halves(b, len(a))
        assert len(a) == len(b)
        differ = len(np.setxor1d(*sets))
        apart = int(np.bitwise_count((a ^ b).view(np.uint64)).sum())
        assert apart <= differ and (apart - differ) % 2 == 0 and apart >= 0.4 * differ
