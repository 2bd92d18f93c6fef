"""PySpark-native engine for vector-graphics tokenization and evaluation."""

from .errors import EngineError
from .functions.ids import TOKENIZER_VERSION, VOCAB_ID
from .operators.codec import detokenize, tokenize

__all__ = ["TOKENIZER_VERSION", "VOCAB_ID", "EngineError", "detokenize", "tokenize"]
