"""The search-box language: syntax tree, parser, and its translation to leaves and conditions."""
