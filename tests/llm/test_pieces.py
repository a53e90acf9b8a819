import struct
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from tests.conftest import DATA
from tessera.llm import pieces

pytestmark = pytest.mark.skipif(not Path(pieces.MODEL).exists(), reason="no model file")
TEXTS = ["", " ", "a", " a", "a ", "  two  blanks  ", "tab\tline\nend\n", "▁mark ▁", "<s> </s> <unk>", "ünï 漢字 🎉 \x00\x01", "é" * 50, "a" * 3000, "1234567890 %%%&&&", " x y"]


def test_parity_with_the_files_own_library():
    texts = pq.read_table(DATA / "sf0.001/documents.parquet")["text"].to_pylist()
    assert pieces.verify(TEXTS + texts) == []


def test_units_and_whole_texts_give_the_same_ids():
    import pyarrow as pa

    texts = TEXTS + pq.read_table(DATA / "sf0.001/documents.parquet")["text"].to_pylist()[:60]
    tool = pieces.Encoder(pieces.raw_model(), room=50)  # it forgets again and again
    size, flat = tool.encode(pa.array(texts))
    at = 0
    for t, n in zip(texts, size):
        assert flat[at : at + n].tolist() == tool.tool.encode(t, add_special_tokens=False).ids
        at += n


def field(number, value):
    def varint(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def test_unigram_model_written_by_hand(tmp_path):
    """Scores, byte fallback, squeezed blanks: parity with the file's own library."""
    own = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", -20.0, 6) for b in range(256)]
    own += [(p, s, 1) for p, s in [("▁", -3.0), ("a", -4.0), ("b", -4.1), ("c", -5.0), ("ab", -5.5), ("▁ab", -6.0), ("abc", -7.7), ("bc", -6.1), ("▁a", -5.7), ("aa", -6.6)]]
    raw = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in own)
    raw += field(2, field(3, 1) + field(35, 1)) + field(3, field(1, b"identity") + field(3, 1) + field(4, 1) + field(5, 1))
    path = tmp_path / "own.model"
    path.write_bytes(raw)
    model = pieces.parse(raw)
    assert model.kind == 1 and model.byte_fallback and model.unk == 0 and len(model.pieces) == len(own)
    texts = ["abc", "abcab", "a b  c", "aaab abc bca", "", "ab é", " abc ", "cccaab", "abz", "a<s>b</s>", "<unk>"]
    assert pieces.verify(texts, str(path)) == []


def test_round_trip_of_rows(spark, messy):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (77, None), (0, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = pieces.encoded(df, check=True).collect()
    assert len(got) == len(rows)
    assert all(r["restored"] for r in got if r["doc_id"] != 7)  # the marker itself becomes a blank
    assert [r["ids"] for r in got if r["doc_id"] == 77] == [None]
    assert all(r["n_tokens"] == len(r["ids"]) for r in got if r["ids"] is not None)
    back = {(r["doc_id"], r["text"]) for r in pieces.decoded(pieces.encoded(df)).collect()}
    assert back == {(d, None if t is None else t.replace("▁", " ")) for d, t in rows}
    out = pieces.encoded(messy, check=True)
    assert out.columns == ["doc_id", "n_tokens", "ids", "restored"] and out.where("NOT restored").count() == 0
    assert pieces.encoded(df.limit(0)).count() == 0
