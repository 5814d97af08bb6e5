"""All registered queries of this subpackage."""

from pairpref.llm import (  # noqa: F401
    byte_bpe,
    chat_format,
    embedding_dedup,
    jaccard_join,
    line_dedup,
    packing,
    prefix_trie,
    quality_rules,
    source_mixing,
    spelling,
    substring_dedup,
    url_filter,
    warc,
)
from pairpref.llm.catalog import EQUIVALENT_SQL, QUERIES  # noqa: F401
