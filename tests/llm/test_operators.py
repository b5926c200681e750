"""Small fixtures against brute force; nulls, empties, repeats, ties and clashing column names in each."""

import base64
import collections
import hashlib
import random
import re
import time

import numpy as np
import pytest

from nodeloom.llm import bpe, embedding_dedup, exact_dedup, html_extract, language_id, license_scan, mixing, ngram_join, suffix_dedup, warc

BLANK = re.compile(r"[\x20\x09-\x0D]+")


def corpus(seed=3, n=90):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 5))) for _ in range(60)]
    passage = [rnd.choice(words) for _ in range(40)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "One"), (5, "a b c d")]
    for k in range(6, n):
        w = [rnd.choice(words) for _ in range(rnd.randint(1, 60))]
        if k % 3 == 0:
            w = w[:10] + passage + w[10:]
        if k % 5 == 0 and rows[k // 2][1]:
            w = rows[k // 2][1].split(" ")
            w[rnd.randrange(len(w))] = "new"
        if k % 11 == 0:
            w = (rows[k - 1][1] or "x").split(" ")
        rows.append((k, " ".join(w)))
    return rows + [rows[20]]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1, "x") for i, t in rows], "doc_id long, text string, h string, n int, x string")


def components(n, links):
    top = list(range(n))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    return [find(k) for k in range(n)]


def test_suffix_dedup(spark):
    rows, length = corpus(), 30
    enc = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(x[p : p + length] for _, x in enc for p in range(len(x) - length + 1))
    want = []
    for i, x in enc:
        gone = bytearray(len(x))
        for p in range(len(x) - length + 1):
            if seen[x[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for q in range(len(x)) if gone[q] and (not q or not gone[q - 1]))
        want.append((i, len(x), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(x, gone) if not g)).hexdigest(), len(x) - sum(gone)))
    for group in (512, 2):
        got = suffix_dedup.suffix_dedup(frame(spark, rows), length=length, gram=10, group=group)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert suffix_dedup.suffix_dedup(frame(spark, rows).limit(0)).count() == 0


def test_suffix_dedup_of_a_text_longer_than_a_piece(spark):
    """A passage over the border of two pieces of a 2.5 MB text, again later in it and in another text."""
    rng = np.random.default_rng(8)
    letters = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage, cut = letters(1500), suffix_dedup.SLICE
    long = letters(cut - 700) + "A" + passage + "B" + letters(300_000) + "C" + passage + "D" + letters(50_000)
    rows = [(1, long), (2, letters(100) + "E" + passage[:450] + "F" + letters(100)), (3, letters(2000))]
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(frame(spark, rows)).collect()}
    kept = long.replace(passage, "")
    assert len(long) > 2_300_000 and got[1][1:] == (len(long), 3000, 2, hashlib.sha256(kept.encode()).hexdigest(), len(kept))
    assert (got[2].n_removed, got[2].n_spans, got[3].n_removed) == (450, 1, 0)


@pytest.fixture
def uneven(spark):
    """A session that joins by exchange and splits partitions of over 2 KB."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_suffix_dedup_deals_an_anchor_with_many_contexts_to_many_tasks(uneven, tmp_path, monkeypatch):
    rnd, length, group = random.Random(4), 30, 16
    some = lambda n: bytes(rnd.randrange(97, 123) for _ in range(n))
    middle, narrower = some(22), suffix_dedup._narrower
    rows = [(7, k, 0, 4, 1, some(4), middle + some(8)) for k in range(800)] + [(k, k, 0, 0, 1 + k % 2, b"", some(30)) for k in range(1000, 1100)]
    rows[1] = (*rows[1][:5], rows[0][5], rows[0][6][:-1] + b"!")  # all but the last byte

    def told(*args):
        def run(batches):
            batches = list(batches)
            (tmp_path / f"{time.time_ns()}-{rnd.random()}-{sum(b.num_rows for b in batches)}").touch()
            yield from narrower(*args)(iter(batches))

        return run

    monkeypatch.setattr(suffix_dedup, "_narrower", told)
    contexts = suffix_dedup.written(uneven.createDataFrame(rows, suffix_dedup._CONTEXT).repartition(16))
    got = suffix_dedup._repeated_starts(contexts, length, group, (7,)).collect()
    assert {(r.k, r.h) for r in got} == {(7, 0), (7, 1)} | {(k, k) for k in range(1001, 1100, 2)}
    taken = [int(p.name.rsplit("-", 1)[1]) for p in tmp_path.iterdir()]
    assert sum(taken) == 800 and max(taken) < 400, taken


def test_ngram_join(spark):
    rows = corpus()
    sets = []
    for _, t in rows:
        w = [x for x in BLANK.split(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    top = components(len(rows), links)
    want = sorted((i, len(s), rows[t][0]) for (i, _), s, t in zip(rows, sets, top))
    for block in (512, 2):
        got = ngram_join.ngram_components(frame(spark, rows), block_sets=block)
        assert sorted(map(tuple, got.collect())) == want
    assert ngram_join.ngram_components(frame(spark, rows).limit(0)).count() == 0
    lost = ngram_join.ngram_components(frame(spark, [(None, "a b"), (1, "a b")])).collect()
    assert {(r.doc_id, r.component_id) for r in lost} == {(None, None), (1, 1)}


def test_embedding_dedup(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 16))
    rows = [(k, base[k % 40] + (0.02 * rng.normal(size=16) if k >= 40 else 0), k % 2) for k in range(160)]
    rows = [(i, v.tolist(), g) for i, v, g in rows] + [(200, None, 0), (201, [0.0] * 16, 0), (202, [float("nan")] * 16, 0), (203, rows[0][1].tolist(), None), (204, rows[3][1].tolist(), 1), (205, [], 0)]
    good = [(i, np.array(v), g) for i, v, g in rows if v and g is not None and np.isfinite(v).all() and any(v)]
    links = [(a, b) for a in range(len(good)) for b in range(a) if good[a][2] == good[b][2] and good[a][1] @ good[b][1] / np.linalg.norm(good[a][1]) / np.linalg.norm(good[b][1]) >= 0.98]
    n, top = collections.Counter(x for p in links for x in p), components(len(good), links)
    want = {g[0]: (n[k], good[top[k]][0]) for k, g in enumerate(good)}
    want |= {i: (0, i) for i, *_ in rows if i not in want}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for block in (512, 3):
        got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.embedding_dedup(df, block=block).collect()}
        assert got == want
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0


def test_exact_dedup_even_when_hashes_collide(spark):
    from pyspark.sql import functions as F

    rows = corpus()
    norm = [BLANK.sub(" ", t or "") for _, t in rows]
    by = collections.defaultdict(list)
    for (i, _), x in zip(rows, norm):
        by[x].append(i)
    want = sorted((i, min(by[x]), len(by[x]), i == min(by[x]), hashlib.sha256(x.encode()).hexdigest()) for (i, _), x in zip(rows, norm))
    for weak in (exact_dedup.hash128, lambda c: F.length(c) % 3):
        assert sorted(map(tuple, exact_dedup.exact_dedup(frame(spark, rows), content_hash=weak).collect())) == want
    assert exact_dedup.exact_dedup(frame(spark, rows).limit(0)).count() == 0


def test_exact_dedup_deals_a_large_group_to_many_tasks(uneven, monkeypatch):
    from pyspark.sql import functions as F

    spread = {}

    def counted(df, name):
        table = suffix_dedup.written(df.withColumn("task", F.spark_partition_id()), name)
        spread[name] = max(r["count"] for r in table.groupBy("task").count().collect())
        return table.drop("task")

    monkeypatch.setattr(exact_dedup, "written", counted)
    rows = [(k, "one text" if k % 3 else f"text {k}") for k in range(1200)]
    docs = suffix_dedup.written(frame(uneven, rows).repartition(16), "docs")
    got = counted(exact_dedup.exact_dedup(docs), "result")
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got.collect()} == {(k, 1, 800) if k % 3 else (k, k, 1) for k in range(1200)}
    assert max(spread[name] for name in ("copies", "compared", "result")) < 500, spread


def test_mixing_nears_its_targets(spark):
    rows = [(k, "w " * (k % 50), None if k % 7 == 0 else f"s{k % 5}") for k in range(2000)] + [(9000, None, "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.copies_of(df).collect()
    assert len(got) == len(rows)
    total = sum(r.size for r in got)
    targets = {r.source: (r.target, r.source_size) for r in got}
    assert sum(t for t, _ in targets.values()) == pytest.approx(1.5 * total)
    for s, (t, size) in targets.items():
        assert t <= 2 * size + 1e-6
        assert abs(sum(r.taken for r in got if r.source == s) - t) <= 100
    assert all(r.taken <= 2 * r.size for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.copies_of(df.repartition(5)).collect()))
    assert mixing.copies_of(df.limit(0)).count() == 0


def test_bpe_is_the_librarys(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = corpus() + [(500, "it's  <|endoftext|>x\n\n 漢字 😀\t"), (501, "  ")]
    got = {r.doc_id: r for r in bpe.encode_documents(frame(spark, rows), path, keep_ids=True).collect()}
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    texts = {r.doc_id: r.text for r in bpe.decode_ids(spark.createDataFrame([(i, got[i].ids) for i, _ in rows[:-1]], "doc_id long, ids array<int>").dropDuplicates(["doc_id"]), path).collect()}
    assert all(texts[i] == (x or "") for i, x in rows[:-1])
    assert bpe.encode_documents(frame(spark, rows).limit(0), path).count() == 0
    twice = spark.createDataFrame([(1, got[6].ids), (1, got[7].ids), (None, got[8].ids), (None, []), (3, None)], "doc_id long, ids array<int>")
    assert sorted(str(r.text) for r in bpe.decode_ids(twice, path).collect()) == sorted([rows[6][1], rows[7][1], rows[8][1], "", ""])


def test_bpe_of_very_long_and_nameless_texts(spark):
    """Texts over a block's size, null ids, and texts of one length: each row has the library's ids."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path, rnd = public_tokenizers.path("byte_bpe_50k.json"), random.Random(1)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 9))) for _ in range(5000)]
    long = " ".join(rnd.choices(words, k=7_000_000))
    rows = [(1, long), (None, "same size"), (None, "size same"), (None, None), (2, "x" * 300)]
    assert len(long) > bpe.BLOCK_BYTES
    t = Tokenizer.from_file(path)
    want = sorted((str(i), len(e.ids), hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest()) for i, e in ((i, t.encode(x or "", add_special_tokens=False)) for i, x in rows))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256) for r in bpe.encode_documents(frame(spark, rows), path).collect()) == want


def test_warc_round_trip(spark, tmp_path):
    long = "é<p>\r\n\r\n" * 5000 + "\r\n"
    html = [None, "", "a", "a", long, "\r\n\r\n", "x\r\n", long, "WARC/1.1\r\n\r\n"]
    rows = [(k, f"http://x/{k}\r\n" if k else None, h, "clash") for k, h in enumerate(html)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    path = str(tmp_path / "w")
    warc.write_warc(df, path, chunk_bytes=1000)
    chunks = warc.read_warc(spark, path)
    parts = collections.defaultdict(dict)
    for r in chunks.collect():
        parts[r.record_id][r.chunk_no] = r
        assert len(r.chunk) <= 1000
    first = {}
    for k, h in enumerate(html):
        first.setdefault(h or "", k)
    index = {r.record_id: r for r in warc.index_of(chunks).collect()}
    assert len(index) == len(html)
    for k, h in enumerate(html):
        data, r = (h or "").encode(), index[f"urn:page:{k}"]
        assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        if first[h or ""] == k:
            got = parts[f"urn:page:{k}"]
            assert r.warc_type == "response" and b"".join(got[c].chunk for c in sorted(got)) == data
        else:
            assert r.warc_type == "revisit" and r.refers_to == f"urn:page:{first[h or '']}"


def test_warc_of_repeated_page_ids_and_no_pages(spark, tmp_path):
    rows = [(1, "a"), (1, "bbbbbb"), (2, "a"), (3, "bbbbbb"), (None, "a"), (None, "zz"), (4, "c"), (4, "c")]
    df = spark.createDataFrame([(k, None, h) for k, h in rows], "page_id long, url string, html string")
    warc.write_warc(df, str(tmp_path / "w"))
    got = sorted((r.record_id, r.payload_bytes, r.warc_type, r.refers_to or "") for r in warc.index_of(warc.read_warc(spark, str(tmp_path / "w"), payloads=False)).collect())
    one = "urn:page:1"
    assert got == sorted([(one, 1, "response", ""), (one, 6, "response", ""), ("urn:page:2", 1, "revisit", one), ("urn:page:3", 6, "revisit", one), ("urn:page:none", 1, "revisit", one), ("urn:page:none", 2, "response", ""), ("urn:page:4", 1, "response", ""), ("urn:page:4", 1, "response", "")])
    warc.write_warc(df.limit(0), str(tmp_path / "empty"))
    assert warc.index_of(warc.read_warc(spark, str(tmp_path / "empty"))).count() == 0


def test_language_id(spark):
    rnd = random.Random(2)
    parts = {"en": ["the", "ing", "th", "er", "wh"], "de": ["sch", "der", "ung", "üb", "ei"]}
    rows = [(k, " ".join("".join(rnd.choice(parts[g]) for _ in range(3)) for _ in range(rnd.randint(3, 40))), g) for k, g in ((k, "en" if k % 2 else "de") for k in range(400))]
    df = spark.createDataFrame(rows + [(900, None, "en"), (901, "123 !!", None), (902, "", "de")], "doc_id long, text string, lang string")
    model = language_id.train(df.where(~language_id.held_out()))
    got = {r.doc_id: r for r in language_id.identify(df, model).collect()}
    assert len(got) == 403 and all(got[k].lang_pred == "und" and got[k].score == 0 for k in (900, 901, 902))
    assert sum(got[i].lang_pred == g for i, _, g in rows) >= 395
    nothing = language_id.train(df.limit(0))
    assert {r.lang_pred for r in language_id.identify(df, nothing).collect()} == {"und"}


def test_html_extract(spark):
    p = "This is a paragraph of the article, with words enough to tell a story in full. "
    page = f"<html><head><title>no</title><script>var t='</p>';</script></head><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav><div class='ad'>Buy.</div><article><h1>Tit&amp;le</h1><p><b>{p}<br><p>{p}&#233;<form>Sub<input></form><aside>See</aside><div class='comments'><p>{p}</div></article><footer>&copy;</footer>"
    df = spark.createDataFrame([(k, "u", page) for k in range(30)] + [(90, "u", None), (91, None, "")], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_extract.extract_pages(df, html_extract.train(df)).collect()}
    assert got[0].text == f"Tit&le\n\n{p.strip()}\n\n{p}é" and got[0].n_chars == len(got[0].text)
    assert got[90].text == got[91].text == "" and len(got) == 32


def test_marginals_are_those_of_enumeration():
    import itertools
    import math

    counts = {("run=2,none,True", 1): 9, ("run=2,none,True", 0): 2, ("node", 1): 20, ("node", 0): 30, ("run=1,none,False", 0): 7, ("word=ad", 0): 3}
    model = html_extract.TreeModel(counts, {(1, 1, 0, 0): 40, (1, 1, 0, 1): 4, (1, 0, 1, 1): 30, (0, 0, 1, 0): 2, (0, 1, 1, 1): 9, (1, 2, 1, 0): 3})
    for source in ("<div><p>one two three four.</p><ul><li>x</ul></div>", "<nav>x</nav><article><p>one two three four.</p><div class='ad'>x</div></article>", "<main><aside><p>one two three four.</aside></main>"):
        page = html_extract.parse(source)
        own = [sum(model.odds.get(f, 0.0) for f in fs) for fs in page.features]
        tables = model.pairs["<div><p>" not in source]
        total, on = 0.0, [0.0] * len(own)
        for s in itertools.product((0, 1), repeat=len(own)):
            w = math.exp(sum(o for o, x in zip(own, s) if x) + sum(tables[page.group[k]][s[page.parent[k]]][s[k]] for k in range(1, len(own))))
            total += w
            for k, x in enumerate(s):
                on[k] += w * x
        assert model.marginals(page) == pytest.approx([x / total for x in on])


def made_pages(n=80):
    """(page, page with all its containers renamed, article)"""
    rnd, out = random.Random(9), []
    words = lambda k: " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 7))) for _ in range(k))
    for _ in range(n):
        title, ps = words(6), [words(rnd.randint(5, 90)) + "." for _ in range(rnd.randint(3, 9))]
        nav = "".join(f"<li><a href='/{k}'>{words(1)}</a></li>" for k in range(6))
        page = f"<html><head><title>{title}</title></head><body><nav><ul>{nav}</ul></nav><div class='ad'>{words(8)}.</div><article><h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in ps) + f"</article><footer>&copy; {words(7)}.</footer></body></html>"
        other = page.replace("<nav>", "<div>").replace("</nav>", "</div>").replace("<div class='ad'>", "<div class='k7'>").replace("article>", "div>").replace("footer>", "div>")
        out.append((page, other, "\n\n".join([title, *ps])))
    return out


def test_html_extract_decides_by_what_it_has_learned(spark):
    made = made_pages()
    pages = spark.createDataFrame([(k, "u", x, "clash") for k, (x, _, _) in enumerate(made)], "page_id long, url string, html string, text string")
    model, blank = html_extract.train(pages), html_extract.TreeModel({}, {})
    got = {r.page_id: r.text for r in html_extract.extract_pages(pages, model).collect()}
    assert all(got[k] == article for k, (_, _, article) in enumerate(made))
    assert sum(model.extract(other) == article for _, other, article in made) >= 78  # no name is left to go by
    assert sum(blank.extract(other) == article for _, other, article in made) == 0
    assert html_extract.extract_pages(pages.limit(0), html_extract.train(pages.limit(0))).count() == 0
    promo = "<div class='promo'><p>" + "one two three four five. " * 4 + "</div>"
    taught = html_extract.TreeModel({("node", 1): 900, ("node", 0): 900, ("word=promo", 1): 400, ("word=promo", 0): 1}, {(0, 2, 0, 1): 300})
    assert blank.odds["word=promo"] < -9 < 0 < taught.odds["word=promo"] and taught.marginals(html_extract.parse(promo))[-1] > blank.marginals(html_extract.parse(promo))[-1]


def test_html_extract_of_a_very_long_page(spark):
    long = "<p>" + "word " * 100_000 + ".</p>"
    page = f"<nav><a href=x>Home</a></nav><article>{long * 5}<aside>{long}</aside></article>"
    got = html_extract.extract_pages(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string"), html_extract.TreeModel({}, {})).first()
    assert got.text == "\n\n".join(["word " * 100_000 + "."] * 5)


def test_license_scan(spark):
    rows = [(1, "x y.\nReleased under the  MIT License.\nmore"), (2, None), (3, ""), (4, "ALL RIGHTS RESERVED! Licensed under CC BY-NC 4.0."), (5, "See the License for the specific language governing permissions and limitations under the License. You may not use this file except in compliance with the License.")]
    got = {r.doc_id: (r.n_known, r.licenses) for r in license_scan.license_scan(frame(spark, rows)).collect()}
    assert got[1][1] == "mit" and got[2] == (0, "") and got[3] == (0, "")
    assert got[4][1] == "all-rights-reserved,cc-by-nc-4.0" and got[5] == (2, "")


def test_license_scan_of_wrapped_and_embedded_texts(spark):
    import textwrap

    rules, rnd = license_scan.RULES + license_scan.COMMON, random.Random(4)
    prefixes = ["", "# ", "// ", " * ", "    ", "; ", "! ", "> ", "dnl "]
    rows = []
    for name, sentences in rules:
        for k in range(4):
            mark, end = rnd.choice(prefixes), rnd.choice(["\n", "\r\n"])
            body = textwrap.wrap(" ".join(sentences), rnd.choice([40, 72, 80, 500]), break_long_words=False, break_on_hyphens=False)
            body = ["A module of ours", "", *body, ""] if k % 2 else ["Some words first.", *body]
            rows.append((len(rows), end.join(mark + x for x in body) + f"{end}{end}int main() {{}}"))

    def anywhere(sentence, x):  # the words with only other characters (or a comment word) between: no split at all
        return re.search("(?<![a-z0-9])" + "(?:[^a-z0-9]|(?<=\n)dnl )+".join(re.findall("[a-z0-9]+", sentence.lower())) + "(?![a-z0-9])", x.lower())

    def brute(x):
        return ",".join(sorted({name for name, sentences in rules if all(anywhere(s, x) for s in sentences)}))

    got = {r.doc_id: r.licenses for r in license_scan.license_scan(frame(spark, rows)).collect()}
    for k, (i, x) in enumerate(rows):
        assert rules[k // 4][0] in got[i].split(","), x
        assert set(got[i].split(",")) <= set(brute(x).split(",")), x
    gpl = textwrap.fill(" ".join(dict(license_scan.RULES)["gpl"]), 75)
    assert len(gpl.splitlines()) > 3
    assert license_scan.license_scan(frame(spark, [(1, gpl)])).first()[1:] == (2, 1, "gpl")


@pytest.mark.parametrize("stored", [False, True])
def test_pipeline_stages_keep_columns_of_any_name_and_type(spark, tmp_path, stored):
    import corpus_pipeline

    extra = ["_row", "_order", "_key", "row", "order", "number", "key", "copies", "_metadata"]
    rows = [(i, t, "en", "s0", 1, *[f"{c}{k}" for c in extra], {"k": k}) for k, (i, t) in enumerate(corpus())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra) + ", m map<string,int>")
    given = {tuple(r[:-1]) + (r[-1]["k"],) for r in rows}
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        if stored:
            docs.write.parquet(str(tmp_path / str(n)))
            docs = spark.read.parquet(str(tmp_path / str(n)))
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *extra, "m"]
        found = [tuple(r)[:-1] + (r["m"]["k"],) for r in docs.collect()]
        assert found and set(found) <= given


def test_pipeline_is_brute_force_with_null_and_repeated_ids(spark, tmp_path):
    import duckdb
    import public_tokenizers
    from tokenizers import Tokenizer

    import __spark_entry__ as entry
    import corpus_pipeline

    rnd, rows = random.Random(5), []
    words = ["".join(rnd.choice("abcde") for _ in range(rnd.randint(2, 5))) for _ in range(80)]
    for k in range(90):  # texts of different lengths, so that the mix has no ties
        x = [rnd.choice(words) for _ in range(20 + k)]
        rows.append(((None if k % 3 == 0 else 7 if k % 3 == 1 else 100 + k), " ".join(x), "en", f"s{k % 2}"))
        if k % 9 == 0:  # a near copy, without an id as the first
            rows.append((None, " ".join(x[:-1] + ["new"] + ["q"] * (k % 2)), "en", "s0"))
        if k % 10 == 1:  # equal texts: with the id of others, without one, and with a larger one
            rows += [(7, " ".join(x), "en", "s1"), (None, "  ".join(x), "en", "s0"), (9000 + k, " ".join(x), "en", "s1")]
        if k % 10 == 3:  # equal texts without an id, and rows that go although others have their id
            rows += [(None, rows[-1][1], "en", "s1"), (7, "123 !!", "en", "s0"), (None, None, "en", "s0")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))

    last = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    model = language_id.train(docs.where(~language_id.held_out()))
    names, score = model.predict([r[1] or "" for r in rows])
    left = [r for r, n, s in zip(rows, names, score) if n != "und" and s >= corpus_pipeline.LEAST_SCORE]
    assert any(r[0] is None for r in left) and sum(r[0] == 7 for r in left) > 20
    first = {}
    for r in sorted(left, key=last):
        first.setdefault(BLANK.sub(" ", r[1]), r)
    left = list(first.values())
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (r[1].split() for r in left)]
    top = components(len(left), [(a, b) for a in range(len(left)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    groups = collections.defaultdict(list)
    for r, t in zip(left, top):
        groups[t].append(r)
    assert len(groups) < len(left)
    left = [min(g, key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest())) for g in groups.values()]
    sizes = [(r[3], len(r[1].split()), r[0]) for r in left]
    assert len(set(sizes)) == len(sizes)
    left.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(k, r[1], r[3]) for k, r in enumerate(left)])
    t, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), collections.Counter()
    for k, size, *_, taken in con.execute(entry.oracle_sql()["op8_source_mixing"]).fetchall():
        ids = t.encode(left[k][1], add_special_tokens=False).ids
        want[left[k][0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()] += taken // size
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == +want


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, extra string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() == 0 and got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_language_filter_is_counting_by_sets():
    """Scores against exact sets of n-grams, counted one by one."""
    rnd = random.Random(6)
    parts = {"aa": ["ka", "lo", "mi", "Éa"], "bb": ["sch", "ü", "der"]}
    text = lambda g, n: ", ".join("".join(rnd.choice(parts[g]) for _ in range(rnd.randint(1, 4))) for _ in range(n))
    taught = {g: [text(g, 30) for _ in range(5)] for g in parts}

    def grams(x):
        x = "".join(c if c.isalpha() else " " for c in f" {x.lower()} ")
        for n in (2, 3, 4):
            for k in range(len(x) - n + 1):
                g = x[k : k + n]
                if (n == 2 and g != "  ") or (n > 2 and " " not in g[1:-1]):
                    yield g

    known = {g: {y for x in xs for y in grams(x)} for g, xs in taught.items()}
    model = language_id.LanguageFilter(sorted(parts), {g: np.unique(np.concatenate([h for _, h in language_id.gram_hashes(xs)])) for g, xs in taught.items()})
    asked = [text("aa", 12), text("bb", 12), "ka sch", "12 !?", "", text("aa", 3) + " " + text("bb", 9), text("bb", 200_000)]
    names, score = model.predict(asked)
    for x, name, got in zip(asked, names, score):
        own = collections.Counter(grams(x))
        total = sum(own.values())
        share = {g: sum(n for y, n in own.items() if y in known[g]) / total for g in parts} if total else {}
        assert name == ("und" if not total else max(sorted(share), key=share.get)) and abs(got - max(share.values(), default=0)) < 1e-3


@pytest.mark.parametrize("width, hashes", [(64, 1), (64, 2), (64, 3), (64, 4), (64, 5), (48, 3)])
def test_probes_miss_no_close_pair(width, hashes):
    """Recall of the shipped tables and probes at each number of hashes that row counts give, at the threshold itself."""
    rng = np.random.default_rng(hashes)
    a, n = rng.normal(size=(1500, width)), rng.normal(size=(1500, width))
    a /= np.linalg.norm(a, axis=1)[:, None]
    n -= (n * a).sum(1)[:, None] * a
    b = 0.98 * a + (1 - 0.98**2) ** 0.5 * n / np.linalg.norm(n, axis=1)[:, None]
    x, y = (embedding_dedup.probe_codes(v, embedding_dedup.TABLES, hashes, embedding_dedup.PROBES, 7 + width) for v in (a, b))
    met = (x[:, :, None] == y[:, None, :]).any(axis=(1, 2))
    assert met.mean() >= 0.999


def test_license_scan_is_linear_in_lines():
    scanner = license_scan.Scanner(license_scan.RULES + license_scan.COMMON)
    start = scanner.longest and next(w for w, n in scanner.longest.items() if n > 5)
    took = []
    for n in (50_000, 400_000):
        began = time.perf_counter()
        assert scanner.hits(f"{start} of a log\n--\n" * n) == []
        took.append(time.perf_counter() - began)
    assert took[1] < 30 * took[0]


def test_license_scan_of_an_empty_table(spark):
    assert license_scan.license_scan(frame(spark, [])).count() == 0


def test_licenses_expected_by_hand(spark):
    mit = """
    /* Permission is hereby granted, free of charge, to any person obtaining a copy
     * of this software and associated documentation files (the "Software"), to deal
     * in the Software without restriction, including without limitation the rights
     * to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
     * copies of the Software, and to permit persons to whom the Software is
     * furnished to do so, subject to the following conditions:
     *
     * The above copyright notice and this permission notice shall be included in
     * all copies or substantial portions of the Software. */"""
    texts = [mit, mit.replace("hereby", "gladly"), "prose " * 300_000 + "\n" + mit]
    got = {r["doc_id"]: r["licenses"] for r in license_scan.license_scan(frame(spark, list(enumerate(texts)))).collect()}
    assert got[0] == "mit" and got[1] == "" and got[2] == got[0]
