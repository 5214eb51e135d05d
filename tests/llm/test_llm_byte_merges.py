"""Ids of byte-level tokenizers against the library."""
import random

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from corpuslab.llm.byte_merges import ByteIds
from corpuslab.llm.token_counts import tokenizer_parts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_equal_the_library():
    rng = random.Random(1)
    plain = list("aabcdeghilmnorstuABCÉéèñßØŁǅȺıſ 0123456789.,!?-<|>_\n'’¿«½²ª")
    wild = plain + list("\t\r\x1c\x85\xa0中😀́​İ") + ["<|endoftext|>", "  ", " \n", "\n\n", "'s", "'ll"]
    texts = ["".join(rng.choice(plain) for _ in range(rng.randint(0, 300))) for _ in range(800)]
    texts += ["".join(rng.choice(wild) for _ in range(rng.randint(0, 200))) for _ in range(400)]
    texts += [" ".join("".join(rng.choice("abcdéñßtheing.,;:!?\n'1") for _ in range(rng.randint(1, 12))) for _ in range(60)) for _ in range(600)]
    texts += ["".join(rng.choice("thequickbrownfox") for _ in range(k)) for k in range(90)]
    texts += ["", None, " ", "a ", "a  b", "x" * 5000, " a <|endoftext|>b", "a\n", "\n", "\na", "a\nb", "1234567 89", " 5", "a1b2_c", "é" * 30]
    tokenizer, reader = Tokenizer.from_file(PATH), ByteIds(*tokenizer_parts(PATH))
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [ids.tolist() for ids in reader.texts(pa.array(texts))] == want
    assert [ids.tolist() for ids in reader.texts(pa.array(["in front", *texts])[1:])] == want
    assert reader.texts(pa.array([], pa.string())) == [] and [len(x) for x in reader.texts(pa.array([None, ""], pa.string()))] == [0, 0]
