"""WARC archives and token files: exact round trips."""

import hashlib

import tiktoken

from lodestone.llm import tokencount, warc
from tests.llm.helpers import ODD, docs, prose


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, payload string, n int")


LONG = "<p>" + prose(1, 400) + "</p>"
ROWS = [(1, "http://a/é", LONG), (5, None, LONG), (3, "http://b\r\nX: y", LONG), (4, "u", "short"), (6, "u", "short"), (7, "u", None), (8, "u", ""), (9, "u", "ß" * 999), (10, "u", "ß" * 999), (None, "u", LONG), (5, "again", LONG), (12, "u", "z" * 300_000)]


def test_read_back(spark):
    got = warc.read_back(warc.write(pages(spark, ROWS))).collect()
    want = []
    for i, _, h in ROWS:
        raw = (h or "").encode()
        response = max(j for j, _, g in ROWS if (g or "") == (h or "") and j is not None)
        revisit = len(raw) >= 1000 and i != response
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", response if revisit else None))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_payloads_once_and_records_whole(spark):
    archive = warc.write(pages(spark, ROWS))
    assert archive.payloads.count() == len({h or "" for _, _, h in ROWS})
    records = warc.rebuild(archive).collect()
    assert len(records) == len(ROWS)
    for r in records:
        head, _, block = bytes(r["record"]).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        told = dict(x.split(": ", 1) for x in lines[1:])
        assert lines[0] == "WARC/1.1" and block.endswith(b"\r\n\r\n") and int(told["Content-Length"]) == len(block) - 4
        http, _, payload = block[:-4].partition(b"\r\n\r\n")
        if told["WARC-Type"] == "response":
            assert hashlib.sha1(payload).hexdigest() == told["WARC-Payload-Digest"][5:] and f"Content-Length: {len(payload)}".encode() in http
        else:
            assert payload == b"" and "WARC-Refers-To" in told


def test_no_pages_and_only_null_ids(spark):
    assert warc.read_back(warc.write(pages(spark, ROWS).limit(0))).collect() == []
    got = warc.read_back(warc.write(pages(spark, [(None, "u", LONG), (None, "v", LONG)]))).collect()
    assert [r["record_type"] for r in got] == ["response", "response"]


def encoder():
    with open(tokencount.VOCABULARY, "rb") as f:
        return tokencount._encoder(f.read())


def test_counts_equal_tokenising(spark):
    texts = ODD + [prose(i, 30 + i) for i in range(40)] + ["<|endoftext|> is text"] * 2
    encode = encoder()[0].encode_ordinary
    want = sorted((i, len(encode(t or ""))) for i, t in enumerate(texts))
    for block in (7, 64, 1 << 16):  # documents across many blocks, several in one, all in one
        got = sorted((r["doc_id"], r["n_tokens"]) for r in tokencount.count_tokens(docs(spark, texts), block=block).collect())
        assert got == want
    assert isinstance(encoder()[0], tiktoken.Encoding)


def test_no_documents_and_repeated_rows(spark):
    assert tokencount.count_tokens(docs(spark, [])).collect() == []
    got = tokencount.count_tokens(docs(spark, ["one two"] * 3 + [None], ids=[1, 1, None, None])).collect()
    assert sorted(r["n_tokens"] for r in got) == [0, 2, 2, 2]


def test_long_runs_of_spaces_are_one_piece():
    both = encoder()
    for n in (1, 2, 998, 999, 1000, 1001, 1002, 5000, 100_001):
        for text in ("a" + " " * n + "b", " " * n + "\n" * n + "'s x", "\n" * n + "y", "q " + " " * n + " z", "\u3000" * n + "é", " " * n, "x" + "\t" * n + "\n\n" + " " * n):
            assert tokencount.tokens_of(both, text) == both[0].encode_ordinary(text), (n, text[:3])
    assert tokencount.tokens_of(both, " " * 2_000_000 + "x")
