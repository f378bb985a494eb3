"""Token analytics on Spark: exact byte-pair encoding as DataFrame columns."""

from mergeloom.functions.columns import Tokenizer
from mergeloom.functions.kernels import Vocabulary
from mergeloom.functions.patterns import CL, O2
from mergeloom.sources.ranks import load_vocabulary, read_vocabulary, scan_rank_file, vocabulary_frame, write_vocabulary

__all__ = ["CL", "O2", "Tokenizer", "Vocabulary", "load_vocabulary", "read_vocabulary", "scan_rank_file", "vocabulary_frame", "write_vocabulary"]
