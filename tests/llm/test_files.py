from __future__ import annotations

import hashlib
import io
import json
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from flowrill.llm.seekable import SeekableReader, SeekableWriter
from flowrill.llm.token_files import ChunkEncoder, cuts_at_blanks, read_token_files, token_id_output, with_base, write_token_files
from flowrill.llm.warc import archive, parse_record, read_records

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_frames_are_independent_and_checked(tmp_path):
    path = str(tmp_path / "a.zst")
    writer = SeekableWriter(path)
    frames = [b"one" * 100, b"", b"three"]
    assert [writer.write_frame(f) for f in frames] == [0, 1, 2]
    writer.close()
    reader = SeekableReader(path)
    assert len(reader) == 3 and [reader.read_frame(i) for i in (2, 0, 1)] == [frames[2], frames[0], frames[1]]
    data = bytearray((tmp_path / "a.zst").read_bytes())
    stream = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(bytes(data)), read_across_frames=True)
    assert stream.read() == b"".join(frames)  # an ordinary stream to other readers
    data[12] ^= 255
    (tmp_path / "a.zst").write_bytes(bytes(data))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        SeekableReader(path).read_frame(0)
    (tmp_path / "b.zst").write_bytes(b"no seek table here")
    with pytest.raises(ValueError):
        SeekableReader(str(tmp_path / "b.zst"))


def expected_ids(rows):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    start = 0
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        yield doc_id, start, len(ids), zlib.crc32(ids.tobytes())
        start += len(ids)


def test_token_files_round_trip(docs_table, documents, tmp_path):
    got = token_id_output(docs_table, str(tmp_path / "t"), TOKENIZER).collect()
    assert sorted(map(tuple, got)) == list(expected_ids(documents))


def test_only_wanted_documents(spark, docs_table, documents, tmp_path):
    folder = str(tmp_path / "t")
    write_token_files(docs_table, f"{folder}/files", TOKENIZER, frame_bytes=20_000).write.parquet(f"{folder}/index")
    index = with_base(spark.read.parquet(f"{folder}/index")).where("doc_id in (3, 150)")
    assert sorted(map(tuple, read_token_files(index).collect())) == [r for r in expected_ids(documents) if r[0] in (3, 150)]


def test_chunks_are_encoded_as_the_library_does():
    texts = [
        "It's we'll they'd 'tis THE end...  x", "<|endoftext|> a<|startoftext|>b", "tabs\tand\nlines　and\x1cmore",
        "Café ΌΣΟΣ ΑΣ İstanbul K ſ ﬁ", "漢字🙂👩‍👩‍👧 1234 a1b2 __x__ end.", "", " ", "word, word. Word! WORD? .,; !", "Éa. éa, Éa éa'll don't. ²x ª Ǆ",
    ]
    tokenizer = Tokenizer.from_file(TOKENIZER)
    for encoder in (ChunkEncoder(TOKENIZER), ChunkEncoder(TOKENIZER, limit=1)):
        for block in (texts, texts[3:], texts[:1], []):
            expected = [tokenizer.encode(t, add_special_tokens=False).ids for t in block]
            assert [ids.tolist() for ids in encoder.encode(block)] == expected


def test_other_tokenizers_encode_whole_texts(make_docs, tmp_path):
    """A file whose tokens hold the blank before a word: chunks alone would give other ids."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert cuts_at_blanks(TOKENIZER) and not cuts_at_blanks(path)
    tokenizer = Tokenizer.from_file(path)
    texts = ["two  words, and a third", "Ünï 漢字\n x", "", "again two words"]
    assert tokenizer.encode("two words").ids != tokenizer.encode("two").ids + tokenizer.encode("words").ids
    assert [x.tolist() for x in ChunkEncoder(path).encode(texts)] == [tokenizer.encode(t).ids for t in texts]
    rows = list(enumerate(texts))
    got = sorted(token_id_output(make_docs(*rows), str(tmp_path / "t"), path).collect())
    ids = [np.array([*tokenizer.encode(t).ids, 1], "<u4") for t in texts]
    assert [(r.n_tokens, r.ids_crc32) for r in got] == [(len(x), zlib.crc32(x.tobytes())) for x in ids]


def test_changed_rules_are_noticed(tmp_path):
    spec = json.loads(open(TOKENIZER, encoding="utf-8").read())
    for change in ({"normalizer": None}, {"pre_tokenizer": None}, {"added_tokens": [{"content": "a b", "id": 0}]}):
        (tmp_path / "t.json").write_text(json.dumps(spec | change), encoding="utf-8")
        assert not cuts_at_blanks(str(tmp_path / "t.json"))


def test_forgotten_chunks_change_nothing():
    tokenizer, encoder = Tokenizer.from_file(TOKENIZER), ChunkEncoder(TOKENIZER, limit=40)
    for i in range(60):
        texts = [" ".join(f"Word{j % 7} own{i}x, the, The. of {'abc' * (j % 3)}{i}" for j in range(9)), "the of the"]
        assert [x.tolist() for x in encoder.encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(encoder.slots) < 200


def test_token_files_of_odd_rows(messy, make_docs, tmp_path):
    got = token_id_output(messy, str(tmp_path / "t"), TOKENIZER).collect()
    assert len(got) == messy.count()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None, None, 1, 2, 3, 4, 5, 5, 5, 6, 7, 8]
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:])) and starts[0][0] == 0
    assert token_id_output(make_docs(), str(tmp_path / "e"), TOKENIZER).count() == 0


BIG = "<html>" + "é" * 600


def pages(spark, *rows):
    return spark.createDataFrame([(*r, "x", "x") for r in rows], "page_id long, url string, html string, digest string, target string")


def test_revisits(spark, tmp_path):
    rows = [
        (1, "http://a/", BIG), (2, "http://b/", BIG), (9, None, BIG), (9, "http://c/", BIG), (None, "http://d/", BIG),
        (3, "http://e/ é\r\nEvil: 1", "small"), (4, "", "small"), (5, "http://f/", None), (6, "http://g/", ""),
        (7, "http://h/", "x\r\n\r\nWARC/1.1\r\n" * 200), (None, None, "y" * 2000), (None, None, "y" * 2000),
    ]
    index = archive(pages(spark, *rows), str(tmp_path / "w"), frame_bytes=3000, bundle_bytes=4000)
    got = read_records(index).collect()
    values = sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)

    def expected(page_id, html):
        data = (html or "").encode()
        revisit = html == BIG and page_id != 9
        return str((page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 9 if revisit else None))

    assert values == sorted(expected(i, h) for i, _, h in rows)
    assert all(r.payload is None if r.record_type == "revisit" else hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in got)
    wanted = read_records(index.where("page_id = 7")).collect()
    assert [bytes(r.payload).decode() for r in wanted] == [rows[9][2]]
    assert read_records(archive(pages(spark), str(tmp_path / "e"))).count() == 0


def test_payloads_come_back_whole(spark, sf_dir, tmp_path):
    table = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: bytes(r.payload).decode() for r in read_records(archive(table, str(tmp_path / "w"))).where("payload is not null").collect()}
    html = {r.page_id: r.html for r in table.collect()}
    assert got and all(html[i] == text for i, text in got.items())


def test_a_damaged_payload_is_noticed():
    from flowrill.llm.warc import record

    data = record(1, "http://a/", "hello", hashlib.sha1(b"hello").hexdigest(), None, "2020-01-01T00:00:00Z")
    assert parse_record(data, 0)["payload"] == b"hello"
    with pytest.raises(ValueError):
        parse_record(data.replace(b"hello", b"hullo"), 0)
