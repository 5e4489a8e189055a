"""Operators that prepare language-model training corpora. Nothing else in codeloom imports this subpackage."""
