"""The registered queries of this subpackage, and their SQL."""

from weftline.llm.bpe import op6_bpe
from weftline.llm.chat import OP4_SQL, op4_chat_formatting
from weftline.llm.html_text import op7_html_extraction
from weftline.llm.langid import op9_language_id
from weftline.llm.ngram_join import OP10_SQL, op10_ngram_join
from weftline.llm.packing import op2_packing
from weftline.llm.pivots import OP5_SQL, op5_embedding_dedup
from weftline.llm.topk import OP1_SQL, op1_top_k
from weftline.llm.toxicity import op3_toxicity
from weftline.llm.urls import op8_url_filters

QUERIES = {
    "op1_top_k": op1_top_k,
    "op2_packing": op2_packing,
    "op3_toxicity": op3_toxicity,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_bpe": op6_bpe,
    "op7_html_extraction": op7_html_extraction,
    "op8_url_filters": op8_url_filters,
    "op9_language_id": op9_language_id,
    "op10_ngram_join": op10_ngram_join,
}

ORACLE_SQL = {"op1_top_k": OP1_SQL, "op4_chat_formatting": OP4_SQL, "op5_embedding_dedup": OP5_SQL, "op10_ngram_join": OP10_SQL}
