"""Model calls as replaceable parts, with backends that need no network."""
