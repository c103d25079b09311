"""Given tables rendered as session logs and written as files, so that whole passes can be run on them."""
