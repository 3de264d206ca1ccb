"""Operations for preparing language-model training data.

Nothing outside this subpackage imports it.  Every operator takes a DataFrame
with at least ``doc_id`` and ``text`` and reads only the columns it names, so
extra columns, whatever they are called, never clash with the outputs.
"""
