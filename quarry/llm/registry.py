"""The queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from quarry.llm import decontaminate, embedding_dedup, html_text, katz, language, lexical, line_dedup, ngram_join, pieces, pii, stages, token_files, toxicity, vector_codes

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_token_files": token_files.op3_token_files,
    "op4_embedding_dedup": embedding_dedup.op4_embedding_dedup,
    "op5_html_text": html_text.op5_html_text,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_pii": pii.op7_pii,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_katz": katz.op9_katz,
    "op10_pieces": pieces.op10_pieces,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_lexical_search": lexical.op12_lexical_search,
    "op13_language": language.op13_language,
    "pipeline": stages.run,
}
ORACLES = {
    "op1_ngram_join": ngram_join.OP1_SQL,
    "op4_embedding_dedup": embedding_dedup.OP4_SQL,
    "op6_line_dedup": line_dedup.OP6_SQL,
    "op11_vector_codes": vector_codes.OP11_SQL,
    "op12_lexical_search": lexical.OP12_SQL,
}
