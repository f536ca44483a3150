"""Reading and writing tokenizers and corpora."""
