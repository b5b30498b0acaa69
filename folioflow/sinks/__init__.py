"""Tables as documents."""
