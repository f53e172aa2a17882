"""How elements are laid out and stored."""
