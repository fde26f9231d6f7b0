import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from ragstone.llm.packing import PackConfig, default_config, fill, pack_documents, packed_pieces, plan, slices, token_ids


def check(rows, ids_of, window=2048):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc, ids in ids_of.items():
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for group in sequences.values():
        at = 0
        for r in sorted(group, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return len(sequences)


def test_ids_and_sequences_of_the_corpus(spark, corpus, sf):
    config = default_config()
    tokenizer = Tokenizer.from_file(config.tokenizer_path)
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in corpus.items()}
    rows = pack_documents(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    n = check(rows, ids)
    total = sum(map(len, ids.values()))
    assert n <= total // 2048 + 2


def test_fill_is_the_closest_sum():
    rng = random.Random(2)
    for _ in range(200):
        lengths = [rng.randint(1, 40) for _ in range(rng.randint(1, 9))]
        room = rng.randint(1, 120)
        sums = {0}
        for x in lengths:
            sums |= {s + x for s in sums}
        chosen = fill(dict(Counter(lengths)), room)
        assert sum(k * m for k, m in chosen.items()) == max(s for s in sums if s <= room)
        assert not Counter(chosen) - Counter(lengths)


def test_plan_uses_every_length_once():
    rng = random.Random(3)
    counts = Counter(rng.randint(1, 2047) for _ in range(3000))
    used = Counter()
    for chosen, times in plan(counts, 2048):
        assert sum(k * m for k, m in chosen.items()) <= 2048
        used.update({k: m * times for k, m in chosen.items()})
    assert used == counts


def test_slices_dont_change_ids():
    config = default_config()
    text = "Some words, then more words; again and again. " * 400 + "x" * 3000 + " <|endoftext|> tail"
    whole = token_ids(text, config)
    small = PackConfig(config.tokenizer_path, config.ranks_path, config.pattern, slice_chars=100)
    assert (token_ids(text, small) == whole).all()
    plain = text.replace("<|endoftext|>", "")
    assert (token_ids(plain, small) == token_ids(plain, config)).all()
    assert "".join(slices(plain, 100)) == plain
    assert 50256 in whole.tolist()


def test_odd_rows(spark, odd, none):
    rows = pack_documents(odd).collect()
    ids = {r.doc_id for r in rows}
    assert ids == {None, *range(1, 11)}
    assert sum(r.doc_id == 2 for r in rows) == 2 and [r.length for r in rows if r.doc_id == 4] == [1]
    assert pack_documents(none).collect() == []


def test_sequences_hold_the_ids_of_their_texts(spark, corpus, sf):
    config = PackConfig(**{**vars(default_config()), "block_chars": 100_000})
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packed_pieces(docs, config).collect()
    sequences, texts = defaultdict(dict), defaultdict(dict)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length
        sequences[r.sequence_id][r.offset], texts[r.doc_id][r.start] = ids, ids
    assert len({s >> 32 for s in sequences}) > 1
    assert all(sum(map(len, x.values())) <= 2048 for x in sequences.values())
    for doc, text in corpus.items():
        assert (np.concatenate([texts[doc][s] for s in sorted(texts[doc])]) == token_ids(text, config)).all()
    crcs = {(r.doc_id, r.start): r.ids_crc32 for r in pack_documents(docs, config).collect()}
    assert crcs == {(r.doc_id, r.start): zlib.crc32(r.ids) for r in rows}


def test_special_strings_have_the_tokenizers_ids():
    config = default_config()
    tokenizer = Tokenizer.from_file(config.tokenizer_path)
    mark = "<|endoftext|>"
    for text in (mark, mark * 3, f"a {mark}  b", f"x{mark}y {mark}", f"{mark} déjà vu {mark}\n\n{mark}", f"<|{mark}|>", "<|endoftext"):
        assert token_ids(text, config).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]


def test_equal_rows_are_dealt_to_several_blocks(spark):
    config = PackConfig(**{**vars(default_config()), "block_docs": 100})
    rows = [(1, "the same words " * 20)] * 900 + [(2, "other")]
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), config).collect()
    blocks = Counter(r.sequence_id >> 32 for r in got)
    assert len(got) == 901 and len(blocks) > 5 and max(blocks.values()) < 300
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in x) <= 2048 for x in sequences.values())
