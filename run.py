"""Entry point for spark-submit, which takes a file and not a module."""

from verdictflow.__main__ import main

main()
