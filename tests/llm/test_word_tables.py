"""Tables of words are bounded by bytes, whatever the words, and leave a worker with their operator."""

import random
import tracemalloc

import public_tokenizers

from tallyhouse.llm import common, packing, pieces


def paragraphs(n, size, seed):
    rng = random.Random(seed)
    return ["".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(size)) for _ in range(n)]


def test_long_chunks_take_no_room():
    coder = packing.ChunkTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    marked = pieces.ChunkPieces(public_tokenizers.path("piece_bpe_32k.model"))
    texts = paragraphs(60, 400, 1)
    want = [coder.encoder.encode(t, add_special_tokens=False).ids for t in texts]
    coder.encode(texts[0]), marked.encode(texts[:1])
    tracemalloc.start()
    for k in range(40):
        more = paragraphs(50, 400, k + 2)
        for t in more:
            coder.encode(t)
        marked.encode(more)
    grown = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert grown < 4 << 20 and not any(len(c) > packing.LONG for c in coder.chunks) and not any(len(c) > pieces.LONG for c in marked.known)
    assert [list(memoryview(coder.encode(t)).cast("I")) for t in texts] == want
    assert [[marked.model.bos_id(), *marked.model.encode(t), marked.model.eos_id()] for t in texts] == [list(memoryview(i).cast("I")) for i, _ in marked.encode(texts)]


def test_tables_stay_below_their_bytes():
    small = packing.ChunkTokenizer(public_tokenizers.path("word_bpe_49k.json"), word_bytes=1 << 20, chunk_bytes=1 << 20)
    rng = random.Random(3)
    tracemalloc.start()
    for _ in range(40_000):
        small.encode("".join(rng.choice("abcdefghij") for _ in range(9)) + str(rng.randint(0, 9)))
    grown = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert small.chunks.held <= (1 << 20) and grown < 4 << 20


def test_another_operator_drops_the_tables():
    packing.shared_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    common.keeps("packing", packing.shared_tokenizer.cache_clear)
    common.keeps("packing", packing.shared_tokenizer.cache_clear)
    assert packing.shared_tokenizer.cache_info().currsize == 1
    common.keeps("langid", lambda: None)
    assert packing.shared_tokenizer.cache_info().currsize == 0


def test_a_new_operator_begins_with_little_memory():
    """Arrays of the stage before go, and the tables of all workers of an executor fit beside its heap."""
    common.keeps("langid", lambda: None)
    common._power(1000)
    common.keeps("packing", packing.shared_tokenizer.cache_clear)
    assert not common._powers and 2 * (packing.WORD_BYTES + packing.CHUNK_BYTES) <= 200 << 20
    common._power(1000)
    common.keeps("packing", packing.shared_tokenizer.cache_clear)
    assert common._powers  # the same operator goes on with what it has


def test_a_worker_remembers_some_hundred_thousand_chunks():
    """A second pass over 300,000 chunks asks the model for none: within the same bytes a chunk takes some twenty, not two hundred."""
    coder = packing.ChunkTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    texts = [" ".join(f"ab{k:x}!" for k in range(lo, lo + 5000)) for lo in range(0, 300_000, 5000)]
    first = [coder.encode(t) for t in texts]
    asked, cut = [], coder.words
    coder.words = lambda text: asked.append(len(text)) or cut(text)
    assert [coder.encode(t) for t in texts] == first and sum(asked) == 0
    assert list(memoryview(first[7]).cast("I")) == coder.encoder.encode(texts[7], add_special_tokens=False).ids


def test_a_worker_takes_little_beside_an_executors_heap():
    """Tables, tokenizer and what it is made from stay below 80 MB; a task's freed memory goes back when it ends."""
    tracemalloc.start()
    coder = packing.ChunkTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 80 << 20 and coder.words("ab c") == ["ab", " ", "c"]


def test_a_task_ends_with_its_memory_given_back(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    made = common.tidy(lambda batches: (2 * b for b in batches))(iter([1, 2]))
    assert next(made) == 2 and not calls
    assert list(made) == [4] and calls == [1]
