"""Token sizes of documents under the public word-punctuation tokenizer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: words, or runs of anything that is neither word nor white space (the ASCII separators count as white space)
TOKEN = r"(?U)[\w]+|[^\w\s\x1c-\x1f]+"


def token_size(given: str = "n_tokens", text: str = "text") -> Column:
    """The given size; counted from the text where it is null or negative; 0 without text."""
    counted = F.coalesce(F.regexp_count(F.col(text), F.lit(TOKEN)), F.lit(0))
    return F.when(F.col(given) >= 0, F.col(given)).otherwise(counted).cast("long")
