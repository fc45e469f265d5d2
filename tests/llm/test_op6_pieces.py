"""Pieces are encoded together and keep the ids that each has by itself."""

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from touchstone.llm.curve_packing import Encoder, default_tokenizer  # noqa: E402

TEXTS = ["one", " two", "", "\n", "  runs \t of spaces  ", "<s></s><unk><|endoftext|>", "é́ 😀 字字字", "x" * 5000, "a. b, c.", "�", " ", "one"]


class Counting:
    def __init__(self, tokenizer):
        self.tokenizer, self.inputs = tokenizer, 0

    def encode_batch_fast(self, inputs, **kinds):
        self.inputs += len(inputs)
        return self.tokenizer.encode_batch_fast(inputs, **kinds)


def test_ids_of_texts_encoded_together():
    encoder = Encoder(default_tokenizer())
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in TEXTS]
    encoder.tokenizer = Counting(encoder.tokenizer)
    got = encoder.plain([t.encode() for t in TEXTS])
    assert [np.frombuffer(x, encoder.kind).tolist() for x in got] == want
    assert encoder.tokenizer.inputs == 1 and encoder.plain([]) == []
    broken = encoder.plain([b"a b", b"\xff\xfe", b"c"])  # bytes that are no text: one input for each
    assert [np.frombuffer(x, encoder.kind).tolist() for x in broken] == [
        encoder.tokenizer.tokenizer.encode(t, add_special_tokens=False).ids for t in ("a b", "\ufffd\ufffd", "c")]
