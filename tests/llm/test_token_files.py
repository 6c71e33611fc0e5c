"""Token files: leftovers of lost attempts, bounded tables of the encoder."""

from skein.llm import token_files
from tests.llm.test_training_data import docs_of


def test_leftovers_are_swept(spark, tmp_path):
    (tmp_path / "_trial-lost").write_bytes(b"half a file")
    docs = docs_of(spark, ["one two", None, "three"])
    rows = token_files.round_trip(docs, token_files.default_tokenizer(), f"file://{tmp_path}", shards=2).collect()
    assert len(rows) == 3 and sorted(p.name[:6] for p in tmp_path.iterdir() if p.suffix == ".skbp") and not list(tmp_path.glob("_trial*"))


def test_endings_stay_bounded():
    e = token_files.Encoder(token_files.default_tokenizer(), limit=50)
    texts = ["word" + " " * i + "\n" * (i % 7) for i in range(400)]
    got = e.encode(texts)
    assert len(e.tails) <= 52
    assert [len(x) // 4 for x in got] == [len(e.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def test_pieces_are_kept_when_they_come_again():
    """Pieces that come once take no room; all ids are those of whole texts."""
    e = token_files.Encoder(token_files.default_tokenizer())
    texts = [f"every text x{i * 7919}y{i}, again z{i * 104729}" for i in range(3000)]
    for lo in range(0, 3000, 64):
        part = texts[lo : lo + 64]
        assert e.encode(part) == [e._whole(x) for x in part]
    assert len(e.kept) + len(e.old) < 100 and {"text", "again"} <= set(e.kept)
    assert e.encode(texts) == [e._whole(x) for x in texts] and len(e.kept) > 5000


def test_encoders_go_once_shards_are_written():
    token_files._encoder(token_files.default_tokenizer())
    token_files._forget()
    assert not token_files._ENCODERS
    assert token_files._encoder(token_files.default_tokenizer()).encode([""]) == [b""]
