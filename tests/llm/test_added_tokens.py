"""The query of operator 2 against the tokenizers library at its default setting, on texts that quote an added token."""

import zlib

import numpy as np
import public_tokenizers

from prefixloom.llm.queries import op2_token_files

TEXTS = [
    None, "", "plain words", "x <|endoftext|> y", "<|endoftext|> y", "<|endoftext|>", "<|endoftext|><|endoftext|>", "a  <|endoftext|>  b\n",
    "don't<|endoftext|>'s", "\u00e9t\u00e9 <|endoftext|>\n\n \u65e5\u672c", "<|endoftext| >", "word " * 3000 + "<|endoftext|>" + " word" * 3000,
]


def test_added_tokens_have_their_own_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = list(enumerate(TEXTS))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want, start = [], 0
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = op2_token_files(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
