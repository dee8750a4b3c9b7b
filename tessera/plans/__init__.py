"""The dialect's front end: text to statements, statements to resolved plans."""
