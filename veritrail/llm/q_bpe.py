from veritrail.llm.bpe import encode_decode
from veritrail.llm.common import table


def op6_byte_bpe(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, "doc_id", "text")


QUERIES = {"op6_byte_bpe": op6_byte_bpe}
ORACLE_SQL = {}
