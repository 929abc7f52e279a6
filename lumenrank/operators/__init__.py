"""DataFrame operators: lexical, dense, ranking, evaluation, mining, training rows."""
