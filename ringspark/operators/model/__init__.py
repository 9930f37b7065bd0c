"""The message-passing degree model: features, layers, training, evaluation."""
