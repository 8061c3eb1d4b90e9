"""op12: words that were met before are not tokenized again, and the ids stay the library's."""

import random

from lodestrata.llm import alignment
from lodestrata.llm.queries import tokenizer_path

PARTS = ["a", "B", " ", "  ", " ", "\n", "\t", "'s", "'", "é", "1", "٣", "<|endoftext|>", "</s>", "!", "▁", "　", "᠎", "​", "́", "中", "🙂", "word", "\x1c", "\x85", " x", "don't", "y" * 50]


def test_ids_are_the_librarys():
    tokens = alignment.loaded(tokenizer_path("byte_bpe_50k.json"))
    whole = tokens.encode.encode
    r = random.Random(3)
    for _ in range(500):
        texts = ["".join(r.choices(PARTS, k=r.randrange(1, 30))) for _ in range(20)]
        assert tokens.encode(texts) == whole([" " + t for t in texts])


def test_words_are_encoded_once():
    tokens = alignment.Tokens(tokenizer_path("byte_bpe_50k.json"))
    own, given = tokens.encode.encode, []
    tokens.encode.encode = lambda texts: given.extend(texts) or own(texts)
    texts = ["the same few words, " * 50 + str(i) for i in range(40)]
    want = own([" " + t for t in texts])
    assert tokens.encode(texts) == want and tokens.encode(texts) == want
    assert sum(map(len, given)) < 400  # 40 texts of 1,000 characters
