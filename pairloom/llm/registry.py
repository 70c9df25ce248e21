"""The queries of the corpus operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from pairloom.llm.context_tree import op11_context_tree
from pairloom.llm.decontaminate import OP7_SQL, op7_decontamination
from pairloom.llm.langid import op9_langid
from pairloom.llm.merkle import OP13_SQL, op13_merkle
from pairloom.llm.minhash import OP2_SQL, op2_minhash
from pairloom.llm.periodic import op12_periodic
from pairloom.llm.quality import op6_quality
from pairloom.llm.secrets import OP5_SQL, op5_secrets, secrets_second_scan
from pairloom.llm.sentencepiece_bpe import op4_sentencepiece
from pairloom.llm.sharding import OP1_SQL, op1_sharding
from pairloom.llm.token_counts import op10_token_counts
from pairloom.llm.urls import OP3_SQL, op3_urls
from pairloom.llm.warc import OP8_SQL, op8_warc

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_minhash": op2_minhash,
    "op3_urls": op3_urls,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_secrets": op5_secrets,
    "op6_quality": op6_quality,
    "op7_decontamination": op7_decontamination,
    "op8_warc": op8_warc,
    "op9_langid": op9_langid,
    "op10_token_counts": op10_token_counts,
    "op11_context_tree": op11_context_tree,
    "op12_periodic": op12_periodic,
    "op13_merkle": op13_merkle,
    "secrets_second_scan": secrets_second_scan,
}

ORACLE_SQL = {
    "op1_sharding": OP1_SQL,
    "op2_minhash": OP2_SQL,
    "op3_urls": OP3_SQL,
    "op5_secrets": OP5_SQL,
    "op7_decontamination": OP7_SQL,
    "op8_warc": OP8_SQL,
    "op13_merkle": OP13_SQL,
    "secrets_second_scan": OP5_SQL,
}
