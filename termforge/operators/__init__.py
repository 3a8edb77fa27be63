"""DataFrame operators: indexing, ranking, query evaluation, crawling."""
