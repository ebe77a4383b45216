"""Training-data operators: deduplication, language, quality, tokens, mixing and scoring of documents.

Nothing outside this subpackage imports it. Each module holds one operator with its general
interface; ``queries`` derives the digest columns of the registered queries from them.
"""
