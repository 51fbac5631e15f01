"""Exact dedup, line dedup, sharding, PII, token files and URL filter against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeseam.llm import exact_dedup, line_dedup, pii, sharding, token_files, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, size string, line string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "x", "y", "z") for i, t, s in rows], DOCS)


ODD = [
    (1, "a b c", "s"),
    (2, "a b c", "s"),
    (3, None, "s"),
    (4, "", None),
    (None, "a b c", "s"),
    (5, "a b c ", "t"),
    (5, "a b c ", "t"),
    (6, "x" * 200_000 + "\nend", "t"),
    (7, "Über\nÜber\nmail me@x.org", None),
    (None, None, None),
]


@pytest.mark.parametrize("hot_rows", [1000, 1])
def test_exact_dedup_odd_rows(spark, hot_rows):
    for keep, end in (("largest", max), ("smallest", min)):
        got = exact_dedup.exact_dedup(docs_of(spark, ODD), keep, hot_rows=hot_rows).collect()
        groups = defaultdict(list)
        for i, t, _ in ODD:
            groups[t or ""].append(i)
        want = Counter()
        for i, t, _ in ODD:
            g = groups[t or ""]
            want[(i, end((x for x in g if x is not None), default=None), len(g), hashlib.sha256((t or "").encode()).hexdigest())] += 1
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        assert Counter(r.text_sha256 for r in got if r.kept) == Counter({hashlib.sha256(t.encode()).hexdigest(): 1 for t in groups})
        assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_dedup_too_many_hot_texts_for_a_broadcast(spark):
    rows = [(i, f"t{i % 5}", "s") for i in range(40)]
    got = exact_dedup.exact_dedup(docs_of(spark, rows), "largest", hot_rows=2, broadcast_rows=2).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got} == {(i, 35 + i % 5, 8, i >= 35) for i in range(40)}


def test_exact_dedup_of_texts_that_begin_alike(spark):
    rows = [(i, "L" * 200 + str(i % 7 if i % 2 else 0), "s") for i in range(200)]
    got = exact_dedup.exact_dedup(docs_of(spark, rows), "largest", hot_rows=20).collect()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t].append(i)
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got} == {(i, max(g := groups[t]), len(g), i == max(g)) for i, t, _ in rows}


def test_empty_tables(spark):
    docs = docs_of(spark, [])
    for out in (
        exact_dedup.exact_dedup(docs),
        line_dedup.line_dedup(docs),
        sharding.shard_by_bytes(docs),
        pii.pii_digest(docs),
        token_files.read_token_files(
            token_files.write_token_files(docs, token_files.public_path("word_bpe_49k.json"), 2, token_files.new_path(spark, "t"))
        ),
    ):
        assert out.collect() == []


def test_line_dedup(spark):
    rows = [(i, f"menu\nown line {i}\n\nmenu\n{'x' if i < 3 else 'y'}", "h") for i in range(10)]
    rows += [(100 + i, "copy line\nmenu", "h") for i in range(50)] + [(200, "menu\nother", None), (201, None, "h"), (202, "", "h")]
    out = line_dedup.line_dedup(docs_of(spark, rows), report=True)
    assert out.columns == [*DOCS.replace(" long", "").replace(" string", "").split(", "), "n_lines", "n_dropped"]
    got = {r.doc_id: r for r in out.collect()}
    assert got[0].text == "own line 0\n" and got[0].n_dropped == 3  # x is on 3 of 12 different pages
    assert got[100].text == "copy line" and got[200].text == "menu\nother"
    assert got[201].text is None and got[201].n_lines == 0 and got[202].text == ""


def brute_law(rows, shards):
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.size
    return [sizes[i] for i in range(shards)]


def test_sharding_balances_bytes_and_numbers_slots(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = sharding.shard_by_bytes(docs).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {
        i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts.items()
    }
    for k in range(16):
        slots = sorted(r.slot for r in rows if r.shard == k)
        assert slots == list(range(len(slots)))
    assert len(rows) == len(texts)


def test_sharding_subdivides_hot_texts_and_keeps_others_together(spark):
    rows = [(i, "hot text" if i % 3 else f"text number {i // 6}", "s") for i in range(9000)] + [(None, None, "s")] * 3
    got = sharding.shard_by_bytes(docs_of(spark, rows)).collect()
    sizes = brute_law(got, 16)
    assert max(sizes) < 1.1 * min(sizes)
    at = defaultdict(set)
    for r in got:
        at[r.text_crc32].add(r.shard)
    assert [len(s) for k, s in at.items() if k != zlib.crc32(b"hot text")] == [1] * (len(at) - 1)
    for k in range(16):
        slots = sorted(r.slot for r in got if r.shard == k)
        assert slots == list(range(len(slots)))


PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) < 256 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(d := re.sub(r"\D", "", m)) <= 19 and plain_luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub(r"[^0-9]", "", m)) <= 15),
}


def plain_luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0


def plain_spans(text):
    return [(k, m.start(), m.end()) for k, (p, ok) in PLAIN.items() for m in re.finditer(p, text) if ok(m[0])]


@settings(max_examples=400, deadline=None)
@given(
    st.lists(
        st.sampled_from(["a", "@", ".", "-", "+", " ", "(", "1", "25", "256", "4111111111111111", "x.org", "a@b.c", "é", "1.2.3.4", "000", "%", "\n"]),
        max_size=25,
    ).map("".join)
)
def test_pii_base_spans_equal_the_regular_expressions(text):
    assert [s[:3] for s in pii.find_spans(text) if s[0] in pii.BASE] == plain_spans(text)


def test_pii_added_spans_and_context():
    iban = "pay to DE89 3704 0044 0532 0130 00 now"
    assert [s[:3] for s in pii.find_spans(iban) if s[0] == "iban"] == [("iban", 7, 34)]
    assert not [s for s in pii.find_spans(iban.replace("89", "88")) if s[0] == "iban"]
    es, at, de = "ES9121000418450200051332", "AT611904300234573201", "DE89 3704 0044 0532 0130 00"
    for after in ("", " BIC CAIX", " 12 May", " USA", " BANK OF 1999 USA", " AB12 3456 7890 1234 5678", "."):
        for one in (es, at, de):
            assert [s[:3] for s in pii.find_spans(f"to {one}{after}") if s[0] == "iban"] == [("iban", 3, 3 + len(one))]
    assert [s[1] for s in pii.find_spans(f"{es} {de} XX12 3456 7890 {at}") if s[0] == "iban"] == [0, 25, 68]
    amex = "378282246310005"
    assert not pii.find_spans(f"order {amex}") and pii.find_spans(f"my credit card {amex}")[0][0] == "pan"
    assert pii.find_spans("my ssn is 123-45-6789")[0][0] == "ssn" and not pii.find_spans("no 123-45-6789")


def test_pii_long_texts_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000, "1 " * 200_000, "a@" * 100_000, "+1" + " " * 200_000, "1.1." * 50_000, "A1" * 100_000):
        pii.find_spans(text)


def test_pii_query_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = pii.pii_digest(docs.unionByName(docs.limit(1).selectExpr("-1L AS doc_id", "CAST(NULL AS string) AS text", "lang", "source", "n_chars"))).collect()
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows) > 0
    for r in rows:
        want = plain_spans(texts.get(r.doc_id) or "")
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in want) for k in pii.BASE)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()


def test_pii_redaction(spark):
    assert [r.text for r in pii.redacted(docs_of(spark, ODD[8:9])).collect()] == ["Über\nÜber\nmail [email]"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_files.public_path("word_bpe_49k.json"))


def test_token_files_round_trip(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(10_000, None), (10_001, ""), (10_002, "word " * 30_000)], "doc_id long, text string"))
    manifest = token_files.write_token_files(docs, token_files.public_path("word_bpe_49k.json"), 2, token_files.new_path(spark, "t"), sequence=64)
    got = {r.doc_id: r for r in token_files.read_token_files(manifest).collect()}
    start = 0
    for i, t in sorted((r.doc_id, r.text) for r in docs.collect()):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        crc = zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), crc)
        start += len(ids)
    for path, tokens in {(r.path, r.tokens) for r in manifest.collect()}:
        assert sum(int(m.sum()) for m in token_files.SequenceReader(path).masks()) == tokens


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t.,'sİſßΣé\u0301\u00a0\u2028<|endoftext|>1٣ǅ"), st.characters(exclude_categories=["Cs"])), max_size=30))
def test_word_encoder_equals_the_tokenizer(text):
    import numpy as np

    encoder = token_files.shared_encoder(token_files.public_path("word_bpe_49k.json"))
    assert np.frombuffer(encoder.encode(text), encoder.dtype).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_word_encoder_keeps_special_tokens(tokenizer):
    import numpy as np

    encoder = token_files.WordEncoder(token_files.public_path("word_bpe_49k.json"))
    for text in ("a <|endoftext|> b", "<|ENDOFTEXT|>", "It's. Don't, <|endoftext|>.", "ÉTÉ, été."):
        assert np.frombuffer(encoder.encode(text), encoder.dtype).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def plain_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in rules if ("." + host).endswith("." + r[1]) and path.startswith(r[2])]
    best = max(fits, key=lambda r: (len(r[1] + r[2]), len(r[1])), default=None)
    return host, path, best and best[1] + best[2], best[0] if best else "allow"


def test_url_filter_odd_urls(spark):
    urls = [
        "http://a.example.NET/en/x?y", "https://example.net", "http://example.net/", "http://notexample.net/en/", "http://b.example.com/de/1#x",
        "http://example.org/fr/", "http://org/fr/", "http://x.org/en/", "no scheme", "", None, "http:///en/", "http://example.net:80/en/",
        "a://b://c.net/x", "http://x.com?u=http://y.net/", "http://..net/", "http://example.net/en/" + "x" * 50_000, "HTTP://Ä.NET/\nz", "http://" + "a." * 20_000 + "net/x",
    ]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls * 2)], "page_id long, url string, host string, verdict string")
    got = url_filter.judge_urls(pages, url_filter.rules_frame(spark)).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == [
        (i, *plain_verdict(u, url_filter.RULES)) for i, u in enumerate(urls * 2)
    ] or sorted((r.page_id, r.host, r.path, str(r.rule), r.verdict) for r in got) == [
        (i, a, b, str(c), d) for i, u in enumerate(urls * 2) for a, b, c, d in [plain_verdict(u, url_filter.RULES)]
    ]
    assert url_filter.judge_urls(pages.limit(0), url_filter.rules_frame(spark)).collect() == []


def test_url_filter_with_more_lengths_than_can_be_named(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "PATH_LENGTHS", 1)
    urls = ["http://a.b.example.net/en/x", "http://example.com/de/", "http://x.org/fr", "http://x.org/fr/y", "nothing", None, "s://net"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, url_filter.rules_frame(spark)).collect()}
    assert got == {(i, *plain_verdict(u, url_filter.RULES)) for i, u in enumerate(urls)}


def test_line_dedup_beyond_a_broadcast_and_with_clashing_names(spark, monkeypatch):
    rows = [(i, f"menu\nown {i}\n{'again' if i % 2 else 'x'}", f"s{i % 3}") for i in range(60)]
    docs = docs_of(spark, rows).withColumnsRenamed({"lang": "host_key", "size": "bad_lines", "line": "kept_lines", "keep_id": "host_salt"})
    want = sorted((r.doc_id, r.text) for r in line_dedup.line_dedup(docs_of(spark, rows)).collect())
    assert want[0] == (0, "own 0")
    for most in (line_dedup.BROADCAST_BYTES, 1):
        monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", most)
        out = line_dedup.line_dedup(docs)
        assert out.columns == docs.columns and sorted((r.doc_id, r.text) for r in out.collect()) == want


def test_splitters_begin_at_the_first_row_of_a_key():
    rows = [(k % 7 - 3, k, 0, 1.0) for k in range(100)] + [(9, k, 0, 1.0) for k in range(100)]
    cuts, low = sharding._splitters(rows, 16, {9}), -(1 << 63)
    assert all(c[1:] == (low, low) for c in cuts if c[0] != 9) and len([c for c in cuts if c[0] == 9]) > 4
    packed = sharding._ordered(list(np.array(sorted(cuts), "i8").T)).tolist()
    assert all(a < b for a, b in pairwise(packed))


@pytest.mark.parametrize("samples", [32, 1])
def test_sharding_equals_a_plain_recomputation(spark, sf_dir, monkeypatch, samples):
    """Order by hash and doc_id, bytes before, and the hot texts, without ranges or samples."""
    monkeypatch.setattr(sharding, "SAMPLES_PER_RANGE", samples)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    texts += [f"{t[: 20 + 7 * k]} {k}" for t in texts for k in range(12)] + ["same again"] * 900 + ["x" * 60_000, None, ""]
    docs = [(3 * i - 50, t, "s") for i, t in enumerate(texts)]
    got = {r.doc_id: (r.size, r.shard, r.slot) for r in sharding.shard_by_bytes(docs_of(spark, docs), ranges_per_shard=8).collect()}
    signed = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (h >> 63 << 64)
    rows = sorted((signed(t or ""), i, len((t or "").encode()) + 1) for i, t, _ in docs)
    total, part = sum(r[2] for r in rows), defaultdict(float)
    for k, _, size in rows:
        part[k] += size / total + 1 / len(rows)
    many = Counter(r[0] for r in rows)
    hot = {k for k in part if part[k] > 2 * 2 / 128 and many[k] > 1}
    want, at, group, slots = {}, 0, {}, Counter()
    for k, i, size in rows:
        place = at if k in hot else group.setdefault(k, at)
        shard = place * 16 // total
        want[i] = (size, shard, slots[shard])
        slots[shard] += 1
        at += size
    assert hot and got == want
