"""Local grammars of source languages over strings with one character for each token."""
