"""Operations for training-data corpora: ten operators over documents and pages.

Nothing else in the library imports this subpackage; deleting it leaves the rest working.
"""
