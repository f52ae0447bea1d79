"""How jobs are cut, sized and laid out."""
