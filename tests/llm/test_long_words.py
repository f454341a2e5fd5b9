"""Words of more bytes than once fitted the merge queue."""

import random

from tokenizers import Tokenizer

from emberline.llm import bpe
from emberline.llm.queries import WORD_BPE


def test_a_word_of_two_million_bytes():
    text = "x " + "".join(random.Random(3).choices("abcdefgh", k=2_000_000)) + " y"
    want = Tokenizer.from_file(WORD_BPE).encode(text, add_special_tokens=False).ids
    assert bpe.MergeQueueBpe(WORD_BPE).encode(text) == want
