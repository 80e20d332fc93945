"""Queries of the numbered operators and their DuckDB twins."""

from mixshard.llm.bpe import q_bpe
from mixshard.llm.byte_bpe import q_byte_bpe
from mixshard.llm.conversation_repair import SQL_CONVERSATION_REPAIR, q_conversation_repair
from mixshard.llm.embeddings import SQL_EMBEDDINGS, q_embeddings
from mixshard.llm.html import q_html
from mixshard.llm.langid import q_langid
from mixshard.llm.line_chunks import SQL_LINE_CHUNKS, q_line_chunks
from mixshard.llm.mixing import SQL_MIXING, q_mixing
from mixshard.llm.ngram_join import SQL_NGRAM_JOIN, q_ngram_join
from mixshard.llm.pii import q_pii
from mixshard.llm.quality import q_quality
from mixshard.llm.token_counts import q_token_counts
from mixshard.llm.whitening import q_whitening

QUERIES = {
    "op1_token_counts": q_token_counts,
    "op2_ngram_join": q_ngram_join,
    "op3_html": q_html,
    "op4_line_chunks": q_line_chunks,
    "op5_langid": q_langid,
    "op6_embeddings": q_embeddings,
    "op7_pii": q_pii,
    "op8_bpe": q_bpe,
    "op9_mixing": q_mixing,
    "op10_quality": q_quality,
    "op11_conversation_repair": q_conversation_repair,
    "op12_byte_bpe": q_byte_bpe,
    "op13_whitening": q_whitening,
}

#: Twins of the queries that SQL can express; the others are tested against brute force.
SQL = {
    "op2_ngram_join": SQL_NGRAM_JOIN,
    "op4_line_chunks": SQL_LINE_CHUNKS,
    "op6_embeddings": SQL_EMBEDDINGS,
    "op9_mixing": SQL_MIXING,
    "op11_conversation_repair": SQL_CONVERSATION_REPAIR,
}
