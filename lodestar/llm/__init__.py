"""Operations on training text for language models.

Nothing else in the library imports this subpackage; each module holds one
operator with its general interface, ``queries`` holds the registered queries.
"""
