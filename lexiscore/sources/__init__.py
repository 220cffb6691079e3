"""Reading posts and lexicons, writing results."""
