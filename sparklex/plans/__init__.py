"""Multi-step plans: the tokenizer facade, vocabulary training, chat rendering."""
