"""Reading and writing: files, delimited text, cells, vocabularies and archives."""
